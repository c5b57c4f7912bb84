import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from loamstack.model import OPERATIONS
from loamstack.operators import acceptance, edits, work
from loamstack.sinks.ledger import Ledger
from loamstack.sinks.operations import Conflict, LeaseHeld, Operations, Refused

T0 = dt.datetime(2026, 1, 1)
SCHEMA = b"# Schema\nversion: 1\n"


def op(i, **x):
    row = {"operation_id": i, "scope": "s", "adapter": "a", "source_id": i, "version": "1", "digest": "a" * 64, "schema_digest": hashlib.sha256(SCHEMA).hexdigest(), "status": "received", "attempt": 0, "media_type": "text/plain", "manifest_ref": "raw/x/manifest.yaml", "schema_snapshot": bytearray(SCHEMA), "work_attempt": 0, "work_token": "", "work_ready_at": T0, "created_at": T0} | x
    return tuple(row.get(f.name) for f in OPERATIONS.fields)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), OPERATIONS)


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds))


def test_ready_order_leases_and_descriptors(spark):
    ops = table(
        spark,
        op("b"), op("a"), op("late", work_ready_at=T0 + dt.timedelta(seconds=9)),
        op("held", work_token="t", work_expires_at=T0 + dt.timedelta(seconds=50)), op("over", work_token="t", work_expires_at=T0 + dt.timedelta(seconds=5)),
        op("done", status="committed"), op("lost", status="failed"), op("foreign", scope="r"),
        op("bad-ref", manifest_ref="../x"), op("bad-schema", schema_digest="b" * 64), op("legacy", media_type=None), op("huge", schema_snapshot=bytearray(b"x" * ((4 << 20) + 1))),
    )
    assert [r.operation_id for r in work.ready(ops, "s", at(10), 10).collect()] == ["a", "b", "over", "late"]
    assert [r.operation_id for r in work.ready(ops, "s", at(10), 0).collect()] == ["a"]
    assert [r.operation_id for r in work.descriptor_failures(ops, "s").collect()] == ["bad-ref", "bad-schema", "huge", "legacy"]
    claimed = work.claim(ops, "s", at(10), "new", 30, 2)
    assert claimed.columns == ops.columns
    assert {(r.operation_id, r.work_attempt) for r in claimed.where("work_token = 'new'").collect()} == {("a", 1), ("b", 1)}
    assert work.ready(claimed, "s", at(11), 10).count() == 2 and work.ready(claimed, "s", at(41), 10).count() == 4
    renewed = work.renew(claimed, "a", "new", at(20), 30)
    assert work.ready(renewed, "s", at(41), 10).count() == 3
    assert work.ready(work.release(renewed, "a", "new", at(21)), "s", at(22), 10).count() == 3
    assert work.renew(claimed, "a", "wrong", at(20), 30).exceptAll(claimed).count() == 0


def test_fold_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [(k, i, rng.choice([*work.EVENTS, "unknown"])) for k in range(20) for i in range(rng.randrange(9))]

    def fold(key):
        state, applied = "received", 0
        for _, _, e in sorted(r for r in rows if r[0] == key):
            sources, target = work.EVENTS.get(e, ((), None))
            if state in sources:
                state, applied = target, applied + 1
        return state, applied

    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = work.final_states(spark.createDataFrame(shuffled, "k int, i int, event string"), ["k"], ["i"]).collect()
    assert {r.k: (r.status, r.applied) for r in got} == {k: fold(k) for k in {r[0] for r in rows}}


def test_operations_store(spark, tmp_path):
    ops = Operations(Ledger(spark, str(tmp_path)))
    request = table(spark, op("x")).select("scope", "adapter", "source_id", "version", "digest", "schema_digest", "media_type", "manifest_ref", "schema_snapshot")
    first = ops.reserve(request, at(0)).collect()
    assert len(first) == 1 and first[0].operation_id == "s:a:x@1#" + "a" * 16
    assert ops.reserve(request, at(1)).count() == 1
    from loamstack.model import SourceConflict

    with pytest.raises(SourceConflict):
        ops.reserve(request.withColumn("digest", F.lit("c" * 64)), at(1))
    name = first[0].operation_id
    token, ids = ops.claim("s", at(2))
    assert ids == [name] and ops.claim("s", at(3))[1] == []
    assert ops.renew(name, token, at(4)) and not ops.renew(name, "other", at(4))
    with pytest.raises(Refused):
        ops.move(name, "commit", at(5))
    assert [ops.move(name, e, at(6), **({"plan_digest": "d"} if e == "plan" else {})) for e in ("plan", "plan", "review", "review")] == ["planned", "planned", "awaiting_review", "awaiting_review"]
    before = ops.lease(name, T0 + dt.timedelta(seconds=7), 300)
    with pytest.raises(LeaseHeld):
        ops.lease(name, T0 + dt.timedelta(seconds=8), 300)
    assert ops.table().first().attempt == 1
    ops.fenced(name, before, ops.ledger.snapshot())
    now = ops.lease(name, T0 + dt.timedelta(seconds=400), 300)
    assert ops.table().first().attempt == 2
    ops.fenced(name, now, ops.ledger.snapshot())
    with pytest.raises(LeaseHeld):  # taken over
        ops.fenced(name, before, ops.ledger.snapshot())
    assert ops.move(name, "commit", at(401), generation="g") == "committed" == ops.move(name, "commit", at(402), generation="g")
    with pytest.raises(Conflict):
        ops.move(name, "commit", at(403), generation="h")
    with pytest.raises(Refused):
        ops.move(name, "fail", at(402), failure_class="x")
    assert ops.claim("s", at(1000))[1] == []
    assert work.public_operations(ops.table()).first().asDict() == {"operation_id": name, "status": "completed", "failure_class": None, "generation": "g"}


def test_acceptance(spark):
    def env(i, v, content, t, digest=None):
        raw = content.encode()
        return ("s", "a", i, v, digest or hashlib.sha256(raw).hexdigest(), "text/plain", bytearray(raw), T0 + dt.timedelta(seconds=t))

    from loamstack.model import ENVELOPES

    rows = spark.createDataFrame([env("1", "1", "x", 0), env("1", "1", "x", 1), env("1", "1", "y", 2), env("2", "1", "z", 0), env("3", "1", "k", 0)], ENVELOPES)
    known = spark.createDataFrame([env("3", "1", "k", -1), env("2", "1", "other", -1)], ENVELOPES)
    assert [(r.source_id, bytes(r.content)) for r in acceptance.accepted(rows, known, ["received_at"]).collect()] == [("1", b"x")]
    assert sorted((r.source_id, bytes(r.content)) for r in acceptance.conflicts(rows, known, ["received_at"]).collect()) == [("1", b"y"), ("2", b"z")]
    odd = spark.createDataFrame([env(" ", "1", "x", 0), env("1", "1", "", 0), env("1", "1", "x", 0, "d" * 64), env("1", "1", "x", 0, hashlib.sha256(b"x").hexdigest().upper())], ENVELOPES)
    assert [r[0] for r in odd.select(acceptance.valid_envelope()).collect()] == [False, False, False, True]


def test_edits(spark):
    current = spark.createDataFrame([("wiki/a.md", "d1"), ("wiki/b.md", "d2")], "path string, digest string")
    given = spark.createDataFrame([("wiki/a.md", "D1", "[[b]] [[c]] [[nope]]"), ("wiki/b.md", "", ""), ("wiki/c.md", None, ""), ("wiki/d.md", "x", ""), ("wiki/index.md", "y", "[[zz]]")], "path string, expected_digest string, content string")
    assert {r.path: r.outcome for r in edits.preconditions(given, current).collect()} == {"wiki/a.md": "ok", "wiki/b.md": "missing_precondition", "wiki/c.md": "create", "wiki/d.md": "unexpected_precondition", "wiki/index.md": "unexpected_precondition"}
    assert [tuple(r) for r in edits.prospective_broken(given, spark.createDataFrame([("b",)], "page_id string")).collect()] == [("a", "nope")]
