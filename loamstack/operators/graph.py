"""Link reads, one-hop neighbours and the choice of context pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstack.model import ReadLimits, page_limit, require_scope
from loamstack.operators.search import matches, ranked

#: The control page that stands in every context.
CONTROL = "index"


def page_links(links: DataFrame, scope: str, page_id: str, limit: int = 0) -> DataFrame:
    """Links from or to a page, in order."""
    found = links.where((F.col("scope") == require_scope(scope)) & ((F.col("from_page") == page_id) | (F.col("to_page") == page_id)))
    return found.select("from_page", "to_page", "relation").distinct().orderBy("from_page", "to_page", "relation").limit(page_limit(limit))


def undirected(links: DataFrame) -> DataFrame:
    """Every link from either end: scope, page_id, other. Two equality joins take the place of a join on 'or'."""
    out = links.select("scope", F.col("from_page").alias("page_id"), F.col("to_page").alias("other"))
    return out.unionByName(links.select("scope", F.col("to_page").alias("page_id"), F.col("from_page").alias("other")))


def neighbours(seeds: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, page_id, path, rank: pages one link from a seed (scope, page_id, ordinal), no page its own neighbour; rank is the best seed's ordinal."""
    near = undirected(links).join(seeds, ["scope", "page_id"]).where("other <> page_id").select("scope", F.col("other").alias("page_id"), "ordinal")
    best = near.groupBy("scope", "page_id").agg(F.min("ordinal").alias("rank"))
    return best.join(pages.select("scope", "page_id", "path"), ["scope", "page_id"])


def recent(pages: DataFrame, scope: str, without: list[str], limit: int = 0) -> DataFrame:
    """The latest pages of a scope, but for those named."""
    own = pages.where(F.col("scope") == require_scope(scope))
    if without:
        own = own.where(~F.col("page_id").isin(*without))
    return own.orderBy(F.desc("updated_at"), "path").limit(page_limit(limit)).select("page_id", "path", "updated_at")


def candidate_quota(limit: int) -> int:
    """Two thirds of the places beside the control page, rounded up; at least one."""
    return limit if limit <= 1 else max(1, -(-2 * (limit - 1) // 3))


def seeded(hits: DataFrame, scope: str) -> DataFrame:
    """scope, page_id, ordinal of ranked hits (a bounded table: strict, score, path, page_id)."""
    order = Window.orderBy(F.desc("strict"), F.desc("score"), "path", "page_id")
    return hits.select(F.lit(scope).alias("scope"), "page_id", (F.row_number().over(order) - 1).alias("ordinal"))


def merged(limit: int, candidates: DataFrame, near: DataFrame, latest: DataFrame) -> DataFrame:
    """place, page_id: candidates within their quota, neighbours, the control page, more candidates, recent pages; each page once.

    ``candidates``, ``near``, ``latest``: page_id, i (their order). The tables are bounded by the page limit, so that
    windows over all of them are small. Neighbours leave one place for the control page.
    """
    every, of_page = Window.partitionBy(F.lit(0)), Window.partitionBy("page_id")
    phase = lambda df, n: df.where("page_id <> ''").groupBy("page_id").agg(F.min("i").alias("i")).select(F.lit(n).alias("phase"), "i", "page_id")
    control = candidates.sparkSession.range(1).select(F.lit(2).alias("phase"), F.lit(0).alias("i"), F.lit(CONTROL).alias("page_id"))
    ranked_ = phase(candidates, 0).withColumn("k", F.row_number().over(every.orderBy("i"))).withColumn("phase", F.when(F.col("k") <= candidate_quota(limit), 0).otherwise(3)).drop("k")
    rows = ranked_.unionByName(phase(near, 1)).unionByName(control).unionByName(phase(latest, 4))
    # neighbours that are no first candidates, as many as fit
    rows = rows.withColumn("taken", F.min("phase").over(of_page) == 0).where("phase <> 1 OR NOT taken")
    rows = rows.withColumn("first", F.sum(F.when(F.col("phase") == 0, 1).otherwise(0)).over(every)).withColumn("k", F.row_number().over(Window.partitionBy("phase").orderBy("i")))
    rows = rows.where((F.col("phase") != 1) | (F.col("k") <= limit - 1 - F.col("first")))
    once = rows.groupBy("page_id").agg(F.min(F.struct("phase", "i")).alias("at"))
    return once.select((F.row_number().over(every.orderBy("at")) - 1).alias("place"), "page_id").where(F.col("place") < limit)


def search_ranked(pages: DataFrame, scope: str, terms: list[str], limit: int) -> DataFrame:
    """The best pages of a scope, without snippets."""
    return ranked(matches(pages, terms).where(F.col("scope") == require_scope(scope)), len(terms), limit)


def context_pages(pages: DataFrame, links: DataFrame, scope: str, terms: list[str], limit: int) -> DataFrame:
    """place, page_id of the pages to show beside a source with these terms, as one plan."""
    quota, own = candidate_quota(limit), links.where(F.col("scope") == scope)
    hits = search_ranked(pages, scope, terms, max(quota, 1)) if terms and limit > 0 else pages.limit(0).withColumn("strict", F.lit(True)).withColumn("score", F.lit(0.0))
    candidates = seeded(hits, scope)
    first = lambda *by: (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)) - 1).alias("i")
    # twice the limit, since as many may be there already
    near = neighbours(candidates, own, pages.where(F.col("scope") == scope)).orderBy("rank", "path").limit(2 * limit + 1).select(first("rank", "path"), "page_id")
    latest = recent(pages, scope, [], 2 * limit + 1) if limit > 0 else pages.limit(0).select("page_id", "path", "updated_at")
    return merged(limit, candidates.select("page_id", F.col("ordinal").alias("i")), near, latest.select(first(F.desc("updated_at"), "path"), "page_id"))


def select_context(pages: DataFrame, links: DataFrame, scope: str, terms: list[str], limits: ReadLimits | None = None) -> list[str]:
    """Ids of ``context_pages`` in order. Only ids within the page limit reach the driver."""
    found = context_pages(pages, links, scope, terms, (limits or ReadLimits()).page_limit)
    return [r["page_id"] for r in found.orderBy("place").collect()]


def broken(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to pages that don't exist."""
    return links.join(pages.select("scope", F.col("page_id").alias("to_page")), ["scope", "to_page"], "left_anti")


def orphans(pages: DataFrame, links: DataFrame, listed: DataFrame) -> DataFrame:
    """Pages (scope, page_id) without an incoming link or an index entry (scope, page_id)."""
    reached = links.select("scope", F.col("to_page").alias("page_id")).unionByName(listed.select("scope", "page_id"))
    return pages.select("scope", "page_id").join(reached, ["scope", "page_id"], "left_anti")
