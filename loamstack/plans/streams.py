"""Streaming twins of batch queries, drained once over the supplied files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.model import ENVELOPES
from loamstack.plans import views as V
from loamstack.plans.shared import folder
from loamstack.sinks.ledger import Ledger
from loamstack.streaming.ingest import accept_stream
from loamstack.streaming.keyed_state import keyed_state, state_stream


def accepted_once(spark: SparkSession, d: str) -> DataFrame:
    base = folder(spark, "stream")
    V.envelopes(spark, d).select(*ENVELOPES.fieldNames()).write.parquet(f"{base}/in")
    store = Ledger(spark, f"{base}/store")
    accept_stream(spark.readStream.schema(ENVELOPES).parquet(f"{base}/in"), store, ENVELOPES, f"{base}/checkpoint").awaitTermination()
    return store.get("sources", ENVELOPES).select("source_id", "version", "digest")


def states_once(spark: SparkSession, d: str) -> DataFrame:
    """The events in three batches, dealt by a hash, so that each batch has events that are older than those before it."""
    base, parts = folder(spark, "stream"), 3
    V.events(spark, d).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts))).write.partitionBy("part").parquet(f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    given = spark.readStream.schema("op long, ts timestamp, event_id long, event string, part long").option("maxFilesPerTrigger", -(-files // parts)).parquet(f"{base}/in")
    found = state_stream(given, "op", "ts", "event_id")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")

    with keyed_state(spark):
        query = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema("op long, status string, applied long, n_events long, batch int").parquet(f"{base}/out")
    return out.groupBy("op").agg(F.max_by(F.struct("status", "applied", "n_events"), "batch").alias("x")).select("op", "x.*")
