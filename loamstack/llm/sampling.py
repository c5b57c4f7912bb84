"""Bounded, repeatable samples for fitting a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sampled(df: DataFrame, by: list[str], rows: int, per: str | None = None, groups: int = 1000) -> DataFrame:
    """About ``rows`` rows (of each value of ``per``), the same on every run: those whose hash of ``by`` is low.

    The rate follows from one count; nothing is drawn at random. At or below ``rows`` all rows are taken. With
    ``per``, its ``groups`` most frequent values are sampled.
    """
    scale = 1 << 30
    # rows without an id are told apart by what they hold
    plain = [c for c, kind in df.dtypes if kind in ("string", "bigint", "int", "double", "boolean")]
    none = reduce(Column.__and__, [F.col(c).isNull() for c in by])
    low: Column = F.pmod(F.when(none, F.xxhash64(*plain)).otherwise(F.xxhash64(*by)), F.lit(scale))
    if per is None:
        n = df.count()
        return df.where(low < int(scale * min(1.0, rows / n))) if n > rows else df
    rates = {r[0]: min(1.0, rows / r[1]) for r in df.groupBy(per).count().orderBy(F.desc("count"), per).limit(groups).collect()}
    if not rates:
        return df
    limit = F.coalesce(*[F.when(F.col(per).eqNullSafe(F.lit(k)), F.lit(int(scale * x))) for k, x in rates.items()], F.lit(0))
    return df.where(low < limit)


def thinned(table: DataFrame, rows: int) -> DataFrame:
    """A written table of a sample, brought down to about ``rows`` rows if repeated ids have made it larger."""
    n = table.count()
    if n <= rows:
        return table
    scale = 1 << 30
    return table.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(scale)) < int(scale * rows / n))
