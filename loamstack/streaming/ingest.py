"""Streams of envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loamstack.operators.acceptance import KEY, accepted, conflicts, valid_envelope
from loamstack.sinks.ledger import Ledger


def accept_stream(envelopes: DataFrame, ledger: Ledger, schema, checkpoint: str, available_now: bool = True):
    """Accept envelopes from a stream into the ledger's ``sources``; conflicts go to ``conflicts``. A batch writes its own rows only.

    Batches are idempotent: acceptance is an anti join on identity, and a conflict replaces itself.
    """
    names = schema.fieldNames()

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.where(valid_envelope()).select(*names).persist()
        tx = ledger.begin()
        tx.guard("sources")
        known, order = tx.get("sources", schema), ["received_at", "digest"]
        bad = conflicts(rows, known, order).select(*names).distinct()
        new = accepted(rows, known, order).select(*names)
        if not bad.isEmpty():
            tx.upsert("conflicts", bad, [*KEY, "digest"])
        if not new.isEmpty():
            tx.append("sources", new)
        tx.commit(batch=number)
        rows.unpersist()

    writer = envelopes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drain what is there now."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


__all__ = ["KEY", "accept_stream", "run_once"]
