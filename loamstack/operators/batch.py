"""Many questions at once: context pages, hits and the retrieval gate, with quotas and merges as windows by question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.operators.graph import CONTROL, candidate_quota, undirected
from loamstack.operators.index import Index


def _numbered(rows: DataFrame, key: list[str], by: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key with their number from 0; the engine limits each partition before the shuffle."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy(*by)) - 1).where(F.col("i") < limit)


def neighbours(seeds: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """question, scope, page_id, path, rank: pages one link from a question's seeds (question, scope, page_id, ordinal)."""
    near = undirected(links).join(seeds, ["scope", "page_id"]).where("other <> page_id").select("question", "scope", F.col("other").alias("page_id"), "ordinal")
    best = near.groupBy("question", "scope", "page_id").agg(F.min("ordinal").alias("rank"))
    return best.join(pages.select("scope", "page_id", "path"), ["scope", "page_id"])


def context_pages(index: Index, pages: DataFrame, links: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """question, place, page_id of the pages to show beside each question (question, scope, terms).

    The order is that of one question's context: candidates within their quota, neighbours, the control page, more candidates,
    recent pages, each page once. ``pages``: scope, page_id, path, updated_at; no text is read.
    """
    if limit <= 0:
        raise ValueError("a context needs a limit")
    quota = candidate_quota(limit)
    hits = index.top(questions, max(quota, 1)).select("question", "scope", "page_id", F.col("place").alias("ordinal"))
    near = _numbered(neighbours(hits, links, pages), ["question"], ["rank", "path"], 2 * limit + 1)
    latest = _numbered(pages.select("scope", "page_id", "path", "updated_at"), ["scope"], [F.desc("updated_at"), "path"], 2 * limit + 1)
    asked = questions.select("question", "scope")
    phase = lambda df, n: df.select("question", F.lit(n).alias("phase"), "i", "page_id")
    first = hits.select("question", F.when(F.col("ordinal") < quota, 0).otherwise(3).alias("phase"), F.col("ordinal").alias("i"), "page_id")
    rows = first.unionByName(phase(near, 1)).unionByName(asked.select("question", F.lit(2).alias("phase"), F.lit(0).alias("i"), F.lit(CONTROL).alias("page_id"))).unionByName(phase(latest.join(asked, "scope"), 4))
    rows = rows.where("page_id <> ''").repartition("question")  # dealt once for all windows and sums below
    # neighbours that are no first candidates, as many as leave a place for the control page
    rows = rows.withColumn("taken", F.min("phase").over(Window.partitionBy("question", "page_id")) == 0).where("phase <> 1 OR NOT taken")
    rows = rows.withColumn("first", F.sum(F.when(F.col("phase") == 0, 1).otherwise(0)).over(Window.partitionBy("question")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("question", "phase").orderBy("i")))
    rows = rows.where((F.col("phase") != 1) | (F.col("k") <= limit - 1 - F.col("first")))
    once = rows.groupBy("question", "page_id").agg(F.min(F.struct("phase", "i")).alias("at"))
    return _numbered(once, ["question"], ["at"], limit).select("question", F.col("i").alias("place"), "page_id")


def retrieval_gate(index: Index, questions: DataFrame, k: int = 5, threshold: float = 0.85) -> DataFrame:
    """One row, queries, hits, passed: how many questions (question, scope, terms, wanted) find their page among the first ``k``."""
    found = index.top(questions, k).select("question", F.col("page_id").alias("wanted"), F.lit(1).alias("hit"))
    per = questions.select("question", "wanted").join(found, ["question", "wanted"], "left")
    return per.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).withColumn("passed", F.col("hits") >= F.ceil(F.col("queries") * threshold))
