"""Operations: reservation, the state machine as a fold over events, the ready queue, claims and leases.

The table of operations is a snapshot that a single writer replaces (see ``loamstack.sinks.operations``); every
function here is a plan over such a table, with the clock given as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.identity import digest, is_digest
from loamstack.model import MAX_SCHEMA_BYTES, TERMINAL, WORK_SCAN, require_scope

#: Transition by event: the states it may leave, and the state it makes. ``fail`` leaves every state but committed.
STATES = ("received", "planned", "awaiting_review", "applying", "committed", "failed")
EVENTS = {
    "plan": (("received",), "planned"),
    "review": (("planned",), "awaiting_review"),
    "apply": (("planned", "awaiting_review"), "applying"),
    "commit": (("applying",), "committed"),
    "fail": (("received", "planned", "awaiting_review", "applying"), "failed"),
}
#: What a client sees of a state.
PUBLIC = {"received": "queued", "planned": "running", "awaiting_review": "running", "applying": "running", "committed": "completed", "failed": "failed"}


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an event that may not leave the state changes nothing."""
    out = state
    for name, (sources, target) in EVENTS.items():
        out = F.when((event == name) & state.isin(*sources), target).otherwise(out)
    return out


def final_states(events: DataFrame, keys: list[str], order: list[str], event: str = "event") -> DataFrame:
    """keys, status, applied (events that changed the state), n_events: the fold of each key's events in order.

    The fold is an aggregate over the sorted events, within the JVM.
    """
    own = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("_e")))).alias("_events"))
    start = F.struct(F.lit("received").alias("s"), F.lit(0).alias("n"))

    def step(acc, x):
        new = next_state(acc["s"], x["_e"])
        return F.struct(new.alias("s"), (acc["n"] + (new != acc["s"]).cast("int")).alias("n"))

    return own.withColumn("_r", F.aggregate("_events", start, step)).select(*keys, F.col("_r.s").alias("status"), F.col("_r.n").cast("long").alias("applied"), F.size("_events").cast("long").alias("n_events"))


def refused_events(events: DataFrame, keys: list[str], order: list[str], event: str = "event") -> DataFrame:
    """keys, refused, last_refused: how many of a key's events its state did not take, and the last of them."""
    own = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(event).alias("_e")))).alias("_events"))
    start = F.struct(F.lit("received").alias("s"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("last"))

    def step(acc, x):
        new = next_state(acc["s"], x["_e"])
        same = new == acc["s"]
        return F.struct(new.alias("s"), (acc["n"] + same.cast("int")).alias("n"), F.when(same, x["_e"]).otherwise(acc["last"]).alias("last"))

    return own.withColumn("_r", F.aggregate("_events", start, step)).select(*keys, F.col("_r.n").cast("long").alias("refused"), F.col("_r.last").alias("last_refused"))


def public_status(status: Column) -> Column:
    out = F.lit("failed")
    for name, shown in PUBLIC.items():
        out = F.when(status == name, shown).otherwise(out)
    return out


def public_operations(ops: DataFrame) -> DataFrame:
    """What leaves the engine: no descriptor, no lease, no token."""
    return ops.select("operation_id", public_status(F.col("status")).alias("status"), F.when(F.col("status") == "failed", F.col("failure_class")).alias("failure_class"), F.when(F.col("status") == "committed", F.col("generation")).alias("generation"))


def reservations(requests: DataFrame, ops: DataFrame) -> DataFrame:
    """outcome of each request (new, replay, conflict) against the operations, on the four-part key."""
    key = ["scope", "adapter", "source_id", "version"]
    known = ops.select(*key, F.col("digest").alias("known_digest"), "operation_id")
    joined = requests.join(known, key, "left")
    outcome = F.when(F.col("known_digest").isNull(), "new").when(F.col("known_digest") == F.col("digest"), "replay").otherwise("conflict")
    return joined.withColumn("outcome", outcome)


def complete_descriptor() -> Column:
    """Whether a resumable operation has all its inputs."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return full("media_type") & full("manifest_ref") & full("schema_digest") & F.coalesce(F.length("schema_snapshot") > 0, F.lit(False))


def valid_descriptor() -> Column:
    """A complete descriptor that can be trusted: a clean relative manifest path and a bounded schema with its own digest."""
    ref = F.coalesce(F.col("manifest_ref"), F.lit(""))
    clean = ~ref.startswith("/") & ~ref.rlike(r"(^|/)\.{0,2}(/|$)|\\")
    schema = F.col("schema_snapshot")
    own = (F.length(schema) <= MAX_SCHEMA_BYTES) & is_digest(F.col("schema_digest")) & (digest(schema) == F.lower("schema_digest"))
    return complete_descriptor() & clean & F.coalesce(own, F.lit(False))


def free(now: Column) -> Column:
    """No work lease, or one that is over."""
    return (F.coalesce(F.col("work_token"), F.lit("")) == "") | (F.col("work_expires_at") <= now)


def open_operations(ops: DataFrame, scope: str) -> DataFrame:
    return ops.where((F.col("scope") == require_scope(scope)) & ~F.col("status").isin(*TERMINAL))


def ready(ops: DataFrame, scope: str, now: Column, limit: int, scan: int = WORK_SCAN) -> DataFrame:
    """Operations to resume, oldest readiness first. The scan bound comes before the deep check of descriptors."""
    at = F.when(F.coalesce(F.col("work_token"), F.lit("")) == "", F.col("work_ready_at")).otherwise(F.col("work_expires_at"))
    seen = open_operations(ops, scope).where(complete_descriptor() & free(now)).withColumn("ready_at", at).orderBy("ready_at", "operation_id").limit(scan)
    return seen.where(valid_descriptor()).orderBy("ready_at", "operation_id").limit(max(1, limit))


def descriptor_failures(ops: DataFrame, scope: str, limit: int = WORK_SCAN) -> DataFrame:
    """Open operations that can never resume."""
    return open_operations(ops, scope).where(~valid_descriptor()).orderBy("created_at", "operation_id").limit(max(1, limit))


def claim(ops: DataFrame, scope: str, now: Column, token: str, seconds: int, n: int = 1) -> DataFrame:
    """The operations after the first ``n`` ready ones got the lease. One writer calls this and replaces the table."""
    chosen = ready(ops, scope, now, n).select("operation_id", F.lit(True).alias("_own"))
    joined = ops.join(F.broadcast(chosen), "operation_id", "left")  # at most the scan bound of rows
    own = F.coalesce(F.col("_own"), F.lit(False))
    new = {"work_token": F.lit(token), "work_expires_at": now + F.make_dt_interval(secs=F.lit(float(seconds))), "work_attempt": F.coalesce(F.col("work_attempt"), F.lit(0)) + 1}
    return joined.select(*[F.when(own, new[c]).otherwise(F.col(c)).cast(ops.schema[c].dataType).alias(c) if c in new else F.col(c) for c in ops.columns])


def renew(ops: DataFrame, operation_id: str, token: str, now: Column, seconds: int) -> DataFrame:
    """Compare and set on the token; a terminal operation is not renewed."""
    own = (F.col("operation_id") == operation_id) & (F.col("work_token") == token) & ~F.col("status").isin(*TERMINAL)
    return ops.withColumn("work_expires_at", F.when(F.coalesce(own, F.lit(False)), now + F.make_dt_interval(secs=F.lit(float(seconds)))).otherwise(F.col("work_expires_at")))


def release(ops: DataFrame, operation_id: str, token: str, now: Column) -> DataFrame:
    own = F.coalesce((F.col("operation_id") == operation_id) & (F.col("work_token") == token), F.lit(False))
    return ops.withColumns({"work_ready_at": F.when(own, now).otherwise(F.col("work_ready_at")), "work_expires_at": F.when(own, None).otherwise(F.col("work_expires_at")), "work_token": F.when(own, F.lit("")).otherwise(F.col("work_token"))})


def transition(ops: DataFrame, operation_id: str, event: str, now: Column, **values) -> DataFrame:
    """One event on one operation, as a conditional update; ``apply`` also takes an expired apply lease over."""
    sources, target = EVENTS[event]
    may = F.col("status").isin(*sources)
    if event == "apply":
        may = may | ((F.col("status") == "applying") & (F.col("lease_expires_at") <= now))
    own = F.coalesce((F.col("operation_id") == operation_id) & may, F.lit(False))
    new = {k: F.lit(v) for k, v in values.items()} | {"status": F.lit(target), "updated_at": now}
    if event == "apply":
        new["attempt"] = F.coalesce(F.col("attempt"), F.lit(0)) + 1
    return ops.select(*[F.when(own, new[c]).otherwise(F.col(c)).cast(ops.schema[c].dataType).alias(c) if c in new else F.col(c) for c in ops.columns])


def runs_of(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events with their number within the key."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
