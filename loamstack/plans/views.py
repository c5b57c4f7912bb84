"""The engine's tables as views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions.identity import digest, source_ref
from loamstack.functions.markdown import source_title, wiki_links


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the source is the scope, the title the first line."""
    found = digest(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("scope"),
        F.concat(F.lit("docs/"), F.col("doc_id")).alias("page_id"),
        F.concat(F.lit("wiki/docs/"), F.col("doc_id"), F.lit(".md")).alias("path"),
        source_title(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        found.alias("digest"),
        F.array(source_ref(F.lit("docs"), F.col("doc_id").cast("string"), F.concat(F.lit("sha256-"), F.substring(found, 1, 16)))).alias("source_refs"),
        F.lit(True).alias("untrusted"),
        (F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id"))).alias("updated_at"),
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, page_id, path, body of the pages: the whole text and after it three links, one that mostly holds, one that leads out, one with an anchor; every seventh page leaves one open."""
    i = F.col("doc_id")
    extra = F.concat(F.lit("\n[[wiki/docs/"), (i * 7 + 3) % 1100, F.lit(".md|x]] [[../bad]] [[ docs/"), (i * 11 + 5) % 500, F.lit("#a]]"), F.when(i % 7 == 0, " [[open").otherwise(""))
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("scope"), F.concat(F.lit("docs/"), i).alias("page_id"), F.concat(F.lit("wiki/docs/"), i, F.lit(".md")).alias("path"), F.concat(F.coalesce("text", F.lit("")), extra).alias("body"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki_links(linked_pages(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operation events: op, ts, event_id, event."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "plan").when(kind == "click", "review").when(kind == "purchase", "apply").when(kind == "error", "fail").otherwise("commit")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("op"), "ts", "event_id", event.alias("event"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as envelopes, each given twice; every ninth second copy has other content."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    changed = (F.col("copy") == 1) & ((F.col("conv_id") * 31 + F.col("turn")) % 9 == 0)
    content = F.when(changed, F.concat("text", F.lit(" (changed)"))).otherwise(F.col("text"))
    return rows.select(
        F.lit("conv").alias("scope"),
        F.lit("chat").alias("adapter"),
        F.col("conv_id").cast("string").alias("source_id"),
        F.col("turn").cast("string").alias("version"),
        digest(content.cast("binary")).alias("digest"),
        F.lit("text/plain").alias("media_type"),
        content.cast("binary").alias("content"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("copy")).alias("received_at"),
        "copy",
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as operations, with leases, descriptors and states by digits of their key."""
    k = F.col("o_orderkey")
    schema = F.concat(F.lit("# Schema "), k % 5)
    base = 1767225600
    state = F.element_at(F.array(*map(F.lit, ["received", "planned", "awaiting_review", "applying", "committed", "failed"])), (k % 6 + 1).cast("int"))
    leased = k % 4 == 0
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("op-"), F.lpad(k.cast("string"), 9, "0")).alias("operation_id"),
        F.concat(F.lit("scope-"), k % 3).alias("scope"),
        state.alias("status"),
        F.when(k % 6 == 5, F.lit("source: broken")).alias("failure"),
        F.when(k % 6 == 4, F.md5(k.cast("string").cast("binary"))).alias("generation"),
        F.when(k % 11 == 0, "").otherwise("text/plain").alias("media_type"),
        F.when(k % 13 == 0, "/abs/manifest.yaml").when(k % 17 == 0, "raw/../x").otherwise(F.concat(F.lit("raw/"), k, F.lit("/manifest.yaml"))).alias("manifest_ref"),
        F.when(k % 19 == 0, F.repeat(F.lit("a"), 64)).otherwise(F.sha2(schema.cast("binary"), 256)).alias("schema_digest"),
        schema.cast("binary").alias("schema_snapshot"),
        F.when(leased, F.concat(F.lit("t"), k)).otherwise("").alias("work_token"),
        F.when(leased, F.timestamp_seconds(F.lit(base) + k % 1000)).alias("work_expires_at"),
        F.timestamp_seconds(F.lit(base) + (k * 37) % 5000).alias("work_ready_at"),
        F.timestamp_seconds(F.lit(base) + (k * 53) % 7000).alias("created_at"),
        (k % 3).cast("int").alias("work_attempt"),
    )
