"""Keyed state over batches in any order against one fold, bounded lateness, and leases that run out."""

import datetime as dt
import random
import time
from pathlib import Path

import pandas as pd

from loamstack.operators.work import EVENTS, final_states
from loamstack.streaming.keyed_state import keyed_state, state_stream

SCHEMA = "op long, ts timestamp, event_id long, event string"


def fed(spark, tmp_path, batches, until=None, **settings):
    """The rows that each batch gave, when every list of events is a batch of its own."""
    (Path(tmp_path) / "in").mkdir()
    for k, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["op", "ts", "event_id", "event"]).astype({"ts": "datetime64[us]"})
        frame.to_parquet(f"{tmp_path}/in/{k}.parquet")
        time.sleep(0.01)
    out = []

    def keep(batch, n):
        out.append([tuple(r) for r in batch.collect()])

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = state_stream(stream, "op", "ts", "event_id", **settings)
    writer = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c")
    with keyed_state(spark):
        query = (writer if until else writer.trigger(availableNow=True)).start()
    if until:
        end = time.time() + 90
        while not until([r for b in out for r in b]) and time.time() < end and query.isActive:
            time.sleep(0.2)
        query.stop()
    else:
        query.awaitTermination()
    return out


def test_late_events_across_batches_give_the_fold_of_all(spark, tmp_path):
    draw, start, before = random.Random(3), dt.datetime(2026, 1, 1), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    events = [(draw.randrange(12), start + dt.timedelta(seconds=draw.randrange(40)), k, draw.choice([*EVENTS, "plan", "other"])) for k in range(240)]
    out = fed(spark, tmp_path, [events[k::3] for k in range(3)])
    last = {r[0]: r for b in out for r in b}
    whole = final_states(spark.createDataFrame(events, SCHEMA), ["op"], ["ts", "event_id"]).collect()
    assert sorted(r[:4] for r in last.values()) == sorted(tuple(r) for r in whole) and not any(r[4] for r in last.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_what_is_older_than_the_bound_is_late(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(1, at(0), 1, "plan"), (1, at(100), 2, "apply")], [(1, at(50), 3, "fail"), (1, at(95), 4, "review")], [(1, None, 5, "fail"), (1, at(101), 6, "commit"), (2, None, 7, "plan"), (2, at(0), 8, None)]]
    out = fed(spark, tmp_path, batches, lateness_ms=10_000)
    assert out[0] == [(1, "applying", 2, 2, 0)]
    assert out[1] == [(1, "applying", 3, 4, 1)]  # fail of 50 is late; review of 95 takes its place before apply
    assert sorted(out[2]) == [(1, "committed", 4, 6, 2), (2, "planned", 1, 2, 0)]


def test_an_open_key_expires_once_and_a_closed_one_never(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    batches = [[(1, at, 1, "plan"), (2, at, 2, "fail")]]
    out = fed(spark, tmp_path, batches, until=lambda rows: any(r[1] == "expired" for r in rows), lease_ms=500)
    rows = [r for b in out for r in b]
    assert sorted(rows) == [(1, "expired", 1, 1, 0), (1, "planned", 1, 1, 0), (2, "failed", 1, 1, 0)]


def test_a_key_takes_one_read_and_one_write_of_plain_values_in_a_batch():
    from pyspark.sql import Row

    from loamstack.streaming.keyed_state import _operation

    class State:
        value, calls = None, []

        def __getattr__(self, name):
            self.calls.append(name)
            return {"get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda x: setattr(self, "value", x)}[name]

    class Handle:
        def getValueState(self, name, schema):
            return state

    state, one = State(), _operation("op", None, None)
    one.init(Handle())
    batches = [[(1, 50, 2, "review"), (1, 10, 1, "plan")], [(1, 70, 3, None), (1, 20, 4, "fail  \"]")]]
    got = [list(one.handleInputRows((1,), iter([Row("op", "at_micros", "at_tie", "at_event")(*r) for r in b]), None)) for b in batches]
    assert [tuple(r) for b in got for r in b] == [(1, "awaiting_review", 2, 2, 0), (1, "awaiting_review", 2, 4, 0)]
    assert state.calls == ["get", "update"] * 2 and not any(isinstance(x, list) for x in state.value)
