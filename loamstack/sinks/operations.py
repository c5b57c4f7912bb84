"""The operations table: every change writes the rows that it changes, and holds only while the table is as it was read."""

from __future__ import annotations

import datetime as dt
import secrets
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions.identity import operation_id
from loamstack.model import CLAIM_BATCH, OPERATIONS, TERMINAL, WORK_LEASE_SECONDS, SourceConflict
from loamstack.operators import work
from loamstack.sinks.ledger import Ledger, Overtaken, Snapshot, Transaction

TABLE, KEY, TRIES = "operations", ["operation_id"], 8


class Refused(RuntimeError):
    """The operation's state does not take this event."""


class LeaseHeld(Refused):
    """Another runner applies the operation, and its lease is not over; or it took the operation over. To be tried again later."""


class Conflict(Refused):
    """The operation has another plan or generation than the one given."""


class Operations:
    """Reserve, move, claim and read operations of a ledger."""

    def __init__(self, ledger: Ledger):
        self.ledger, self._lock = ledger, threading.RLock()

    def table(self, at: Snapshot | None = None) -> DataFrame:
        return self.ledger.get(TABLE, OPERATIONS, at)

    def row(self, operation: str, at: Snapshot | None = None):
        return self.table(at).where(F.col("operation_id") == operation).first()

    def _change(self, change: Callable[[Transaction, DataFrame], DataFrame | None]) -> DataFrame:
        """Write the rows that ``change`` gives; again from the start if the table has changed meanwhile."""
        with self._lock:
            for _ in range(TRIES):
                tx = self.ledger.begin()
                tx.guard(TABLE)
                rows = change(tx, tx.get(TABLE, OPERATIONS))
                if rows is None or rows.isEmpty():
                    return self.table()
                self.write(tx, rows)
                try:
                    tx.commit()
                except Overtaken:
                    continue
                return self.table()
        raise Overtaken(TABLE)

    def write(self, tx: Transaction, rows: DataFrame) -> None:
        tx.upsert(TABLE, rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OPERATIONS.fields]).coalesce(1), KEY)

    def requested(self, requests: DataFrame, ops: DataFrame, now: Column) -> DataFrame:
        """Rows of the requests (key, digest and descriptor columns) that are new; a replay gives none, a conflict raises."""
        judged = work.reservations(requests.dropDuplicates(["scope", "adapter", "source_id", "version", "digest"]), ops)
        if judged.where("outcome = 'conflict'").limit(1).count():
            raise SourceConflict("a revision was reserved with another digest")
        new = judged.where("outcome = 'new'")
        key = [F.col(c) for c in ("scope", "adapter", "source_id", "version", "digest")]
        given = {"operation_id": operation_id(*key), "status": F.lit("received"), "attempt": F.lit(0), "work_attempt": F.lit(0), "created_at": now, "updated_at": now, "work_ready_at": now}
        have = set(requests.columns)
        return new.select(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPERATIONS.fields])

    def reserve(self, requests: DataFrame, now: Column) -> DataFrame:
        """Add the new requests."""
        return self._change(lambda tx, ops: self.requested(requests, ops, now))

    def moved(self, ops: DataFrame, operation: str, event: str, now: Column, **values) -> DataFrame | None:
        """The row after one event, None if it has taken place already; one that the state does not take raises."""
        own = ops.where(F.col("operation_id") == operation)
        row = own.select("status", "plan_digest", "generation", "lease_token", F.coalesce(F.col("lease_expires_at") > now, F.lit(False)).alias("held")).first()
        if row is None:
            raise KeyError(operation)
        sources, target = work.EVENTS[event]
        for name, at in (("plan_digest", "plan"), ("generation", "commit")):
            if event == at and row["status"] == target:
                if values.get(name) in (None, row[name]):
                    return None
                raise Conflict(f"{operation}: another {name}")
        if event == "apply" and row["status"] == "applying" and row["held"]:
            raise LeaseHeld(operation)
        if event == "review" and row["status"] == target:
            return None
        if row["status"] not in (*sources, *(("applying",) if event == "apply" else ())):
            raise Refused(f"{operation}: {event} of {row['status']}")
        return work.transition(own, operation, event, now, **values)

    def move(self, operation: str, event: str, now: Column, **values) -> str:
        """Apply one event; returns the state after it."""
        self._change(lambda tx, ops: self.moved(ops, operation, event, now, **values))
        return self.row(operation)["status"]

    def lease(self, operation: str, now: dt.datetime, seconds: float) -> str:
        """Begin or take over the apply of an operation; returns the token that its commit has to show."""
        token = secrets.token_hex(16)
        self.move(operation, "apply", F.lit(now), lease_token=token, lease_expires_at=now + dt.timedelta(seconds=seconds))
        return token

    def fenced(self, operation: str, token: str, at: Snapshot) -> None:
        """Raise unless the operation is still being applied under this token."""
        row = self.row(operation, at)
        if row["status"] != "applying" or row["lease_token"] != token:
            raise LeaseHeld(operation)

    def claim(self, scope: str, now: Column, n: int = CLAIM_BATCH, seconds: int = WORK_LEASE_SECONDS) -> tuple[str, list[str]]:
        """A fresh token and the ids of the operations that it now holds."""
        token = secrets.token_hex(16)
        ops = self._change(lambda tx, t: work.claim(t, scope, now, token, seconds, n).where(F.col("work_token") == token))
        return token, [r[0] for r in ops.where(F.col("work_token") == token).select("operation_id").collect()]

    def _leased(self, operation: str, token: str):
        return (F.col("operation_id") == operation) & (F.col("work_token") == token) & ~F.col("status").isin(*TERMINAL)

    def renew(self, operation: str, token: str, now: Column, seconds: int = WORK_LEASE_SECONDS) -> bool:
        """Whether the lease was still the token's."""
        held = self._leased(operation, token)
        ops = self._change(lambda tx, t: work.renew(t.where(held), operation, token, now, seconds))
        return bool(ops.where(held).limit(1).count())

    def release(self, operation: str, token: str, now: Column) -> None:
        self._change(lambda tx, t: work.release(t.where(self._leased(operation, token)), operation, token, now))
