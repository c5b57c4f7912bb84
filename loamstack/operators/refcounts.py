"""Lint of links by counts that edits change: how often each page id is present, linked to and listed.

The counts are a sum over rows, so that an edit adds what the new text names and takes away what the old one named; no
other page is looked at. Findings follow from the narrow counts and the links, without a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.markdown import index_targets, wiki_links
from loamstack.model import struct
from loamstack.operators.lint import ERROR, INDEX_PATH, WARNING, finding

COUNTS = struct("scope string, page_id string, present long, incoming long, listed long")
_KEY, _VALUES = ["scope", "page_id"], ["present", "incoming", "listed"]


def listed(index: DataFrame) -> DataFrame:
    """scope, page_id of every mention in index texts (scope, body)."""
    return index.select("scope", F.explode(index_targets(F.col("body"))).alias("page_id"))


def contributions(pages: DataFrame, mentions: DataFrame, sign: int = 1) -> DataFrame:
    """What pages (scope, page_id, body) and index mentions (scope, page_id) add to the counts, or take away."""
    parts = {"present": pages.select(*_KEY), "incoming": wiki_links(pages).select("scope", F.col("to_page").alias("page_id")), "listed": mentions.select(*_KEY)}
    rows = [part.select(*_KEY, *[F.lit(sign if name == own else 0).cast("long").alias(name) for name in _VALUES]) for own, part in parts.items()]
    return summed(reduce(DataFrame.unionByName, rows))


def summed(rows: DataFrame) -> DataFrame:
    """One row for each page id that is still named; partial sums are made before the shuffle."""
    return rows.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).where("present <> 0 OR incoming <> 0 OR listed <> 0")


def counted_findings(counts: DataFrame, links: DataFrame) -> DataFrame:
    """The findings of ``lint.link_findings`` but that on the index's own syntax; ``counts``: any rows that sum to the counts.

    ``links``: scope, from_page, to_page. A page's path is that of its id.
    """
    now, page = summed(counts), F.col("page_id")
    there, path = F.col("present") > 0, F.concat(F.lit("wiki/"), page, F.lit(".md"))
    index_path = F.lit(INDEX_PATH)
    # each mention of a page that is missing is a finding
    absent = now.where(~there & (F.col("listed") > 0)).select("page_id", F.explode(F.array_repeat(F.lit(1), F.col("listed").cast("int"))))
    gone = now.where(~there & (F.col("incoming") > 0)).select("scope", page.alias("to_page"))
    parts = [
        finding(absent, "index.broken_page", ERROR, index_path, page),
        finding(now.where(there & (F.col("listed") == 0)), "index.missing_page", WARNING, index_path, page),
        finding(now.where(there & (F.col("listed") == 0) & (F.col("incoming") == 0)), "page.orphan", WARNING, path, page),
        finding(links.join(gone, ["scope", "to_page"], "left_semi"), "link.broken", ERROR, None, F.col("from_page"), F.array("to_page")),
    ]
    return reduce(DataFrame.unionByName, parts)
