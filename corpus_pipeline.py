"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. quality      co-trained views reject low-quality documents            (operator 9)
2. exact        of equal texts the row with the largest id stays         (operator 7)
3. near         of similar texts the row with the least id stays         (operator 3)
4. benchmark    documents that hold a benchmark window go                (operator 2)
5. tokens       token ids and decoded text of what is left               (operator 8)

Stages 1 to 4 return the columns of ``documents``; stage 5 returns doc_id,
n_tokens, ids_sha256 and decoded_sha256.

Defined cases, for every stage: a null text counts as empty, and empty texts are
documents like others (equal and similar to each other, no benchmark window, no
token); a null id is an id (below all others in exact, after all others in near);
ties and repeated rows leave one row, the least by its other columns; very long
texts are read whole; an empty table stays empty; further columns pass through
stages 1 to 4 under whatever name.

A stage's result reads intermediate tables until it is written. Each stage begins by
deleting those tables that nothing can read any more, whoever made them; a result that is
still held keeps its tables, in whatever order stages are called.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from loamstack.llm import bpe_transducer, cotrain, decontaminate, exact_dedup, simhash
from loamstack.llm.common import sweep, written

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


#: Columns that stages know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(work):
    """``work`` as a stage: it first deletes tables that are not read any more, and carries further columns under plain names."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        names = docs.columns
        plain = docs.toDF(*[n if n in KNOWN else f"further_{i}" for i, n in enumerate(names)])
        out = work(spark, plain, sf_dir)
        return out.toDF(*names) if out.columns == plain.columns else out

    return stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_rows(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct_rows(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_transducer.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
