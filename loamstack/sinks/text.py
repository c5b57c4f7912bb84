"""Ordered text: a table of lines as numbered files whose concatenation is the text, and its line numbers, without a task that holds it all."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ordered(rows: DataFrame, by: list[str], line: str, folder: str, heading: str = "") -> None:
    """Write ``line`` of each row in the order of ``by``: parts by range, sorted within, named in order (part-00000, part-00001, ...).

    The heading goes before the first row, as a row of its own that sorts before all others.
    """
    body = rows.select(F.lit(1).alias("_head"), *by, F.col(line).alias("value"))
    if heading:
        kinds = {f.name: f.dataType for f in body.schema.fields}
        first = rows.sparkSession.range(1).select(F.lit(0).alias("_head"), *[F.lit(None).cast(kinds[c]).alias(c) for c in by], F.lit(heading).alias("value"))
        body = first.unionByName(body)
    body.repartitionByRange("_head", *by).sortWithinPartitions("_head", *by).select("value").write.text(folder)


def numbered(rows: DataFrame, by: list[str], folder: str, name: str = "line_no") -> DataFrame:
    """``rows`` with their number (from 1) in the order of ``by``, written to ``folder`` by range and read back.

    A row's number is its place in its part and the rows of the parts before; only the parts' counts go to the driver.
    """
    spark, place = rows.sparkSession, F.monotonically_increasing_id()
    parted = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    parted.write.parquet(folder)
    back = spark.read.schema(parted.schema).parquet(folder)
    counts = sorted(tuple(r) for r in back.groupBy("_part").count().collect())
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, [0, *itertools.accumulate(n for _, n in counts)], strict=False)], "_part long, _start long")
    # a row for each part
    return back.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_place") + 1).alias(name))
