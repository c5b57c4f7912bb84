"""Folders for what a registered query writes: below the shared one that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from loamstack.operators import index as I


def folder(spark: SparkSession, label: str) -> str:
    """A new folder. Where no shared one is set, one process makes a temporary one; a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loamstack-")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written_index(pages: DataFrame) -> I.Index:
    """The index of pages, written where it is built, each file in the order of its terms, and read back."""
    spark, base = pages.sparkSession, folder(pages.sparkSession, "index")
    I.ordered(I.blocks(pages)).write.parquet(f"{base}/blocks")
    held = spark.read.schema(I.BLOCKS).parquet(f"{base}/blocks")
    I.extent_of(held).write.parquet(f"{base}/extent")
    return I.Index(held, spark.read.schema(I.EXTENT).parquet(f"{base}/extent"), store=base)
