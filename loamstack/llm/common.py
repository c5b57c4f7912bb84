"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; every executor and the driver can read it, so a lost
executor costs a re-read and not a recomputation of the whole lineage.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path of each table and a weak reference to the relation that reads it.
_WRITTEN: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, one process makes a temporary one; a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        own, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if own.isDefined():
            named = own.get()
        elif re.fullmatch(r"local(\[.*\])?", master):
            named = tempfile.mkdtemp(prefix="loamstack-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


#: Rows of narrow tables that one task may well hold; bytes of a row group.
ROWS_PER_TASK, ROW_GROUP = 100_000, 32 << 20


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage.

    ``rows``, if known, sets the number of tasks that write: as many as the rows need, not more.
    """
    spark = df.sparkSession
    if rows is not None:
        # dealt anew after the work, which keeps its own number of tasks
        df = df.repartition(max(1, -(-rows // ROWS_PER_TASK)))
    path = f"{shared_dir(spark)}/loamstack-{label}-{uuid.uuid4().hex}"
    # small row groups, since a writer holds one of them in memory
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    relation = out._jdf.queryExecution().analyzed().relation()
    _WRITTEN.append((path, spark._jvm.java.lang.ref.WeakReference(relation)))
    return out


def release(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made; their readers end with them."""
    _delete(spark, _WRITTEN[:])


def sweep(spark: SparkSession) -> int:
    """Delete the tables of ``written`` that no DataFrame reads any more, and tell how many went.

    A table belongs to the relation that reads it, which every plan made from it holds; once the JVM has collected that,
    nothing can read the table again. What is still reachable stays, in whatever order results are made and used.
    """
    gc.collect()  # proxies of Python keep their plans
    spark._jvm.System.gc()
    gone = [x for x in _WRITTEN if x[1].get() is None]
    _delete(spark, gone)
    return len(gone)


def _delete(spark: SparkSession, tables: list) -> None:
    for entry in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(entry)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` for columns of our own, each with underscores before it until no column of ``df`` has it."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


#: Bits of a sieve at most (a broadcast of at most 16 MB), bits for each key, and keys of one row of it.
SIEVE_BITS, SIEVE_SHARE, SIEVE_ROW = 1 << 27, 32, 1 << 15


def sieved(rows: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column], name: str) -> DataFrame:
    """``rows`` with the boolean column ``name``, false only where the keys are surely not among those of ``wanted`` (a written table).

    One bit of a bitmap for each hash of the keys: a join that moves wide rows can leave most others where they lie.
    The bitmap grows with ``wanted`` up to SIEVE_BITS; where it would be too full to help, every row may be wanted.
    """
    n = wanted.count()
    if n * 2 > SIEVE_BITS:
        return rows.withColumn(name, F.lit(True))
    bits = max(SIEVE_ROW, min(SIEVE_BITS, 1 << (n * SIEVE_SHARE).bit_length()))
    at = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(bits))
    row, place, bitmap = unused(rows, "sieve_row", "sieve_place", "sieve_bits")
    set_ = wanted.select(at(wanted_keys).alias("p")).select(F.shiftright("p", 15).alias(row), F.col("p").bitwiseAND(F.lit(SIEVE_ROW - 1)).alias("p"))
    # dealt by row first, so that each bitmap is made once and not in every task
    maps = set_.repartition(row).groupBy(row).agg(F.bitmap_construct_agg("p").alias(bitmap))
    placed = rows.withColumn(place, at(keys)).withColumn(row, F.shiftright(place, 15))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(F.col(place).bitwiseAND(F.lit(SIEVE_ROW - 1)), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.col(place).bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return placed.join(F.broadcast(maps), row, "left").withColumn(name, F.coalesce(bit, F.lit(False))).select(*rows.columns, name)


def id_text(id_col: str = "doc_id") -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod ``modulus``."""
    return (F.crc32(id_text(id_col).cast("binary")) % modulus).cast("int")


def text_or_empty(text_col: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def binary_column(batch, name: str) -> list:
    """A string column of an Arrow batch as a list of UTF-8 bytes, null as b''."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def binary_rows(batch, name: str, rows: int = 256):
    """The same, row by row: only ``rows`` of them are held as bytes beside the batch."""
    import pyarrow as pa

    column = batch.column(name).cast(pa.binary())
    for i in range(0, len(column), rows):
        for x in column.slice(i, rows).to_pylist():
            yield x or b""


#: Rows of an Arrow batch of texts, unless the session sets its own.
BATCH_ROWS = 1000


def lean(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in smaller batches than the default: long texts times its 10,000 rows fill a worker."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return df
