"""Acceptance of source revisions: content-hash identity, replay and conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions.identity import digest, inline_id, inline_version, present
from loamstack.model import MAX_SOURCE_BYTES

KEY = ["scope", "adapter", "source_id", "version"]


def decoded(requests: DataFrame) -> DataFrame:
    """Requests (scope, content, uri, media_type, origin, idempotency_key) as envelopes with ``valid``.

    Exactly one of content and uri is given; a URI is stored as text and never fetched.
    """
    inline, uri = F.col("content").isNotNull(), present(F.col("uri")).isNotNull()
    body = F.when(inline, F.col("content")).otherwise(F.col("uri"))
    found = digest(body.cast("binary"))
    return requests.select(
        "*",
        F.when(inline, "inline").otherwise("uri").alias("adapter"),
        inline_id(F.when(inline, F.col("origin")).otherwise(F.col("uri")), F.col("idempotency_key"), found).alias("source_id"),
        inline_version(F.col("idempotency_key"), found).alias("version"),
        found.alias("digest"),
        F.coalesce(present(F.col("media_type")), F.when(inline, "text/plain").otherwise("text/uri-list")).alias("accepted_type"),
        F.coalesce((inline != uri) & (F.octet_length(body) > 0), F.lit(False)).alias("valid"),
    )


def valid_envelope() -> Column:
    """Identity without blanks, content within its bounds, the declared digest is the content's."""
    named = F.lit(True)
    for c in KEY:
        named = named & present(F.col(c)).isNotNull()
    content = F.col("content").cast("binary")
    return named & F.coalesce((F.length(content) > 0) & (F.length(content) <= MAX_SOURCE_BYTES) & (digest(content) == F.lower("digest")), F.lit(False))


def accepted(envelopes: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """New source revisions: the first envelope of each key that the known sources don't hold."""
    first = envelopes.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in envelopes.columns if c not in KEY]), F.struct(*order)).alias("_row"))
    return first.select(*KEY, "_row.*").join(known.select(*KEY), KEY, "left_anti")


def conflicts(envelopes: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Envelopes whose key has another digest, known or given first."""
    first = envelopes.groupBy(*KEY).agg(F.min_by("digest", F.struct(*order)).alias("first"))
    held = known.select(*KEY, F.col("digest").alias("held"))
    joined = envelopes.join(first, KEY).join(held, KEY, "left")
    return joined.withColumn("accepted_digest", F.coalesce("held", "first")).where("digest <> accepted_digest").drop("first", "held")
