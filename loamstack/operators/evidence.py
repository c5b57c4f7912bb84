"""Query composition: hits, citations and the links of the hits, by joins instead of a read for each hit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.identity import digest
from loamstack.model import LimitExceeded, ReadLimits, require_scope
from loamstack.operators.index import Index
from loamstack.operators.index import search as indexed
from loamstack.operators.search import search


@dataclass(frozen=True)
class Evidence:
    hits: DataFrame
    citations: DataFrame
    links: DataFrame


def citations(hits: DataFrame) -> DataFrame:
    """kind, reference, page_id: a wiki citation of each hit and a raw one of each of its sources, raw first."""
    wiki = hits.select(F.lit("wiki").alias("kind"), F.col("path").alias("reference"), "page_id")
    raw = hits.select(F.lit("raw").alias("kind"), F.explode("source_refs").alias("reference"), "page_id")
    return wiki.unionByName(raw).distinct().orderBy("kind", "reference", "page_id")


def hit_links(hits: DataFrame, links: DataFrame, per_page: int, limit: int) -> DataFrame:
    """The first ``per_page`` links of each hit from either end, together, in order, bounded."""
    one = hits.select("page_id")
    out = links.join(one.withColumnRenamed("page_id", "from_page"), "from_page").withColumn("page", F.col("from_page"))
    into = links.join(one.withColumnRenamed("page_id", "to_page"), "to_page").withColumn("page", F.col("to_page"))
    both = out.unionByName(into).select("page", "from_page", "to_page", "relation").distinct()
    rank = F.row_number().over(Window.partitionBy("page").orderBy("from_page", "to_page", "relation"))
    kept = both.withColumn("rank", rank).where(F.col("rank") <= per_page).select("from_page", "to_page", "relation").distinct()
    return kept.orderBy("from_page", "to_page", "relation").limit(limit)


def query(pages: DataFrame, links: DataFrame, scope: str, text: str, limits: ReadLimits | None = None) -> Evidence:
    """Evidence for a question within a scope."""
    limits = limits or ReadLimits()
    hits = search(pages, scope, text, limits.pages, limits.characters)
    return Evidence(hits, citations(hits), hit_links(hits, links.where(F.col("scope") == scope), limits.page_limit, limits.page_limit))


def query_indexed(index: Index, pages: DataFrame, links: DataFrame, scope: str, text: str, limits: ReadLimits | None = None) -> Evidence:
    """The same from the written index: ``pages`` is read by the ids of the hits, a page limit at most."""
    limits = limits or ReadLimits()
    found = indexed(index, pages, scope, text, limits.pages, limits.characters)
    hits = pages.sparkSession.createDataFrame(found.collect(), found.schema)
    return Evidence(hits, citations(hits), hit_links(hits, links.where(F.col("scope") == scope), limits.page_limit, limits.page_limit))


def read_pages(pages: DataFrame, scope: str, ids: list[str], limits: ReadLimits | None = None) -> DataFrame:
    """Pages in the order asked for, up to the page limit; a missing page or a passed size bound raises."""
    limits = limits or ReadLimits()
    asked = [i.removeprefix("wiki/").removesuffix(".md") for i in ids][: limits.page_limit]
    order = pages.sparkSession.createDataFrame([(p, i) for i, p in enumerate(asked)], "page_id string, ordinal int")
    found = pages.where((F.col("scope") == require_scope(scope)) & F.col("page_id").isin(*asked)).join(order, "page_id")
    n, size, chars = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("body")), F.sum(F.char_length("body"))).first()
    if n < len(asked):
        raise KeyError("a page is missing")
    if (size or 0) > limits.bytes or (chars or 0) > limits.characters:
        raise LimitExceeded("pages are larger than the limits of the read")
    return found.orderBy("ordinal").drop("ordinal")


def filed(hits: DataFrame, question: str) -> DataFrame:
    """A query's result as a source: adapter, source_id, version, digest, content (JSON)."""
    rows = hits.agg(F.sort_array(F.collect_list(F.struct("page_id", "path", "title", "snippet"))).alias("hits"))
    content = rows.select(F.to_json(F.struct(F.lit(question).alias("question"), "hits")).alias("content")).withColumn("digest", digest(F.col("content").cast("binary")))
    return content.select(F.lit("query").alias("adapter"), F.concat(F.lit("result-"), F.substring("digest", 1, 16)).alias("source_id"), F.lit("1").alias("version"), "digest", "content")


def encoded(found: Evidence) -> DataFrame:
    """The result as clients get it: one row of JSON with evidence and citations; links stay inside."""
    hits = found.hits.agg(F.collect_list(F.struct("page_id", "path", "title", "snippet", "source_refs", "untrusted")).alias("evidence"))
    cites = found.citations.agg(F.sort_array(F.collect_list(F.struct("kind", "reference", "page_id"))).alias("citations"))
    return hits.crossJoin(cites).select(F.to_json(F.struct("evidence", "citations")).alias("result"))  # one row each


def evaluated(results: DataFrame, expected: DataFrame, threshold: float = 0.85) -> DataFrame:
    """One row, queries, hits, passed: whether enough queries found their page. ``results``: query, page_id; ``expected``: query, page_id."""
    found = expected.join(results.select("query", "page_id").distinct().withColumn("hit", F.lit(1)), ["query", "page_id"], "left")
    per = found.groupBy("query").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("hits")).withColumn("passed", F.col("hits") >= F.ceil(F.col("queries") * threshold))
