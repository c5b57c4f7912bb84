"""Connected components of a table of links, by alternating stars.

A large star links every larger neighbour of a node to the node's least
neighbour; a small star does so for the smaller ones. The links shrink to one
star around each component's least node in a logarithmic number of rounds. Each
round is two joins on written tables, so a hub's links are split by the engine's
skewed-join handling and no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import written


def _star(links: DataFrame, larger: bool, rows: int) -> DataFrame:
    """One star step over directed links (a, b), each meaning {a, b}."""
    both = links if not larger else links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = written(both.distinct(), "links", rows)
    least = written(both.groupBy("a").agg(F.min("b").alias("m")), "least", rows)
    met = both.join(least, "a").withColumn("m", F.least("a", "m"))
    if larger:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the least node reachable. ``links`` (a written table) has columns a, b of one ordered type."""
    rows, before = 2 * links.count(), None
    current = written(links.where("a <> b").select("a", "b").distinct(), "links", rows)
    while True:
        current = written(_star(_star(current, True, rows), False, rows).distinct(), "stars", rows)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return written(roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components", rows)
