"""The state of operations over a stream of events: keyed state that survives events out of order, and leases that run out.

A key's state is its settled fold, and the events after it in order. An event that arrives late is put in its place and
the fold of what follows is made again, so that the result after any batch is that of a batch fold over all events so
far. ``lateness_ms`` bounds what is held: events older than the key's newest by more are folded for good, and one that
arrives for that time afterwards is counted as late and not applied. Without it all events are held, whatever they grow to.

Defined cases: a null time sorts before all others and so is settled first; events of one time apply by ``tie``, then by
name; an unknown or a null event changes nothing but the count; an event given twice is two events.

A key takes one read and one write of its state in a batch, and what is held of its events is one text, since each value that
passes between the worker and the state store costs more than the fold. State of before this form can't be read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loamstack.model import TERMINAL
from loamstack.operators.work import EVENTS

_STATE = "status string, applied long, n_events long, late long, upto long, timer long, waiting string"
#: Before all times.
_FIRST = -(1 << 62)


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """While a query starts, the state store that keyed state with timers needs; the session is then as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _operation(name: str, lateness_ms: int | None, lease_ms: int | None) -> StatefulProcessor:
    """The processor of one key's events. It is made here, with all it needs, so that it travels whole to the workers that plan a stream."""
    moves, closed, schema, first = dict(EVENTS), TERMINAL, _STATE, _FIRST

    def folded(status: str, applied: int, happened) -> tuple[str, int]:
        """The state after events in order, and how many of them changed it."""
        for event in happened:
            sources, target = moves.get(event, ((), None))
            if status in sources:
                status, applied = target, applied + 1
        return status, applied

    class Operation(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("operation", schema)

        def _row(self, key, status: str, applied: int, seen: int, late: int) -> Row:
            return Row(**{name: key[0]}, status=status, applied=applied, n_events=seen, late=late)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            import json

            status, applied, seen, late, upto, timer, held = self.state.get() or ("received", 0, 0, 0, first, -1, "[]")
            new = [[at, tie, event or ""] for *_, at, tie, event in rows]
            in_time = [x for x in new if x[0] >= upto]
            seen, late = seen + len(new), late + len(new) - len(in_time)
            waiting = json.loads(held) + in_time
            waiting.sort()
            if lateness_ms is not None and waiting:
                upto = max(upto, waiting[-1][0] - 1000 * lateness_ms)
                ripe = sum(x[0] < upto for x in waiting)
                status, applied = folded(status, applied, (x[2] for x in waiting[:ripe]))
                waiting = waiting[ripe:]
            shown, changed = folded(status, applied, (x[2] for x in waiting))
            if lease_ms:
                if timer >= 0:
                    self.handle.deleteTimer(timer)
                timer = -1
                if shown not in closed:
                    timer = timerValues.getCurrentProcessingTimeInMs() + lease_ms
                    self.handle.registerTimer(timer)
            self.state.update((status, applied, seen, late, upto, timer, json.dumps(waiting, separators=(",", ":"))))
            yield self._row(key, shown, changed, seen, late)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            import json

            status, applied, seen, late, upto, _, held = self.state.get()
            self.state.update((status, applied, seen, late, upto, -1, held))  # what comes after is folded as before
            yield self._row(key, "expired", folded(status, applied, (x[2] for x in json.loads(held)))[1], seen, late)

        def close(self) -> None:
            pass

    return Operation()


def state_stream(events: DataFrame, key: str, at: str, tie: str, lateness_ms: int | None = None, lease_ms: int | None = None) -> DataFrame:
    """key, status, applied, n_events, late of every key that a batch touches; ``at``: a timestamp, ``tie``: a whole number, and a column ``event``.

    ``lease_ms``: an open key without an event for that long (processing time) is reported once as ``expired``. Start the
    query within ``keyed_state(spark)``. With a lease a query has batches for as long as a timer is set.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.coalesce(F.unix_micros(at), F.lit(_FIRST)).alias("at_micros"), F.coalesce(F.col(tie).cast("long"), F.lit(_FIRST)).alias("at_tie"), F.col("event").alias("at_event"))
    schema = f"{key} {kind}, status string, applied long, n_events long, late long"
    return rows.groupBy(key).transformWithState(_operation(key, lateness_ms, lease_ms), schema, "update", "processingtime" if lease_ms else "none")
