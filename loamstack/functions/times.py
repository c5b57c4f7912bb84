"""Times on the wire: RFC 3339 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A timestamp from RFC 3339 text of any fraction; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))


def written(time: Column) -> Column:
    """RFC 3339 text without trailing zeros, as UTC."""
    text = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


def after(time: Column, seconds: float) -> Column:
    """A time so many seconds later."""
    return time + F.make_dt_interval(secs=F.lit(float(seconds)))
