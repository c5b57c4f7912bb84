import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamstack.engine import Cancelled, Engine, Plan
from loamstack.functions import identity
from loamstack.functions.markdown import wiki_links
from loamstack.model import PAGES, struct
from loamstack.operators import index as I
from loamstack.operators import search
from loamstack.sinks import ledger as L
from loamstack.sinks import projection as P
from loamstack.sinks.operations import LeaseHeld
from tests.test_engine import Clock, maintainer

ROWS = struct("k int, v string")


def rows(spark, *found):
    return spark.createDataFrame(list(found), ROWS)


def content(ledger, table="t"):
    return sorted(map(tuple, ledger.get(table, ROWS).collect()), key=str)


def test_later_segments_win(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    assert ledger.version() == 0 and content(ledger) == []
    ledger.put("t", rows(spark, (1, "a"), (2, "b"), (None, "n")))
    old = ledger.snapshot()
    tx = ledger.begin()
    tx.upsert("t", rows(spark, (2, "B"), (3, "c"), (3, "cc")), ["k"])
    tx.append("u", rows(spark, (9, "u")))
    assert content(ledger) == [(1, "a"), (2, "b"), (None, "n")]
    assert tx.commit(why="test") == 2 and ledger.snapshot().note == {"why": "test"}
    tx = ledger.begin()
    tx.upsert("t", rows(spark).limit(0), ["k"], rows(spark, (3, ""), (None, "")))  # keys without rows: deleted
    tx.append("t", rows(spark, (1, "again")))
    tx.commit()
    assert content(ledger) == [(1, "a"), (1, "again"), (2, "B")] and content(ledger, "u") == [(9, "u")]
    assert sorted(r.v for r in ledger.get("t", ROWS, old).collect()) == ["a", "b", "n"]
    assert L.Ledger(spark, str(tmp_path)).version() == 3 and ledger.generation("u") == 2


def test_a_transaction_follows_a_newer_version_unless_what_it_guards_changed(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    ledger.put("t", rows(spark, (1, "a")))
    one, two = ledger.begin(), ledger.begin()
    one.append("t", rows(spark, (2, "b")))
    two.append("u", rows(spark, (3, "c")))
    two.guard("u")
    one.commit()
    assert two.commit() == 3 and content(ledger) == [(1, "a"), (2, "b")] and content(ledger, "u") == [(3, "c")]
    late = ledger.begin()
    late.guard("t")
    late.append("u", rows(spark, (4, "d")))
    ledger.put("t", rows(spark))
    with pytest.raises(L.Overtaken):
        late.commit()
    asked = ledger.begin()
    asked.append("u", rows(spark, (5, "e")))
    with pytest.raises(ZeroDivisionError):
        asked.commit(lambda newest: newest.version / 0)
    assert content(ledger, "u") == [(3, "c")]


def test_cut_off_manifests_and_orphans_are_recovered(spark, tmp_path):
    ledger = L.Ledger(spark, str(tmp_path))
    for k in range(4):
        ledger.put("t", rows(spark, (k, "x")))
    ledger.begin().append("t", rows(spark, (9, "never")))  # written, never named
    (tmp_path / "manifest-5").write_text('{"version": 5, "tab')
    assert L.Ledger(spark, str(tmp_path)).version() == 4 and content(ledger) == [(3, "x")]
    with pytest.raises(L.Overtaken):
        ledger.put("t", rows(spark))
    assert ledger.recover() == 4  # two old tables, the orphan, what the refused put wrote
    assert sorted(p.name for p in tmp_path.glob("manifest-*")) == ["manifest-3", "manifest-4"]
    ledger.put("t", rows(spark, (7, "y")))
    assert content(ledger) == [(7, "y")]


def test_compaction_keeps_the_rows_and_rewrites_the_first_segment_only_when_the_rest_has_grown(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MANY_SEGMENTS", 3)
    ledger, model, rng = L.Ledger(spark, str(tmp_path)), {k: "0" for k in range(40)}, random.Random(1)
    ledger.put("t", rows(spark, *model.items()))
    first = ledger.snapshot().tables["t"][0]
    for step in range(1, 9):
        new = {k: str(step) for k in rng.sample(range(60), 3)}
        tx = ledger.begin()
        gone = rng.randrange(60)
        tx.upsert("t", rows(spark, *new.items()), ["k"], rows(spark, *new.items(), (gone, "")), n=3)
        tx.commit()
        model = {k: v for k, v in (model | new).items() if k != gone or k in new}
        merged = ledger.compact("t", ROWS)
        assert dict(content(ledger)) == model
        if merged and step < 5:
            assert len(ledger.snapshot().tables["t"]) == 2 and ledger.snapshot().tables["t"][0] == first
    assert ledger.snapshot().tables["t"][0] != first


def written_bytes(root):
    return sum(p.stat().st_size for p in Path(root).rglob("*") if p.is_file())


def test_an_ingest_and_a_move_write_the_same_at_any_size(spark, tmp_path):
    took = []
    for n in (10, 10_000):
        root = tmp_path / str(n)
        engine = Engine(spark, str(root), "s", clock=Clock())
        from loamstack.engine import SOURCES
        from loamstack.model import OPERATIONS

        many = spark.range(n)
        tx = engine.ledger.begin()
        tx.put("sources", many.select(*[(F.concat(F.lit("x"), "id") if f.name == "source_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in SOURCES.fields]))
        tx.put("operations", many.select(*[(F.concat(F.lit("x"), "id") if f.name == "operation_id" else F.lit("committed") if f.name == "status" else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPERATIONS.fields]))
        tx.commit()
        before = written_bytes(root)
        operation = engine.ingest("a", "new", "1", b"text")
        engine.operations.move(operation, "fail", engine.now(), failure_class="x")
        took.append(written_bytes(root) - before)
        assert engine.ledger.get("sources", SOURCES).count() == n + 1 and engine.operation(operation)["status"] == "failed"
    assert took[1] < took[0] * 1.2


def test_the_multiset_hash_follows_edits(spark):
    rng, model, shown = random.Random(4), {}, ""
    frame = lambda m: spark.createDataFrame([("s", v) for v in m], "scope string, v string").select("scope", F.sha2("v", 256).alias("h"))
    full = lambda m: (identity.multiset_hash(frame(m), ["scope"], "h", "d").first() or [None, ""])[1]
    for step in range(5):
        new = {k: f"{k}-{step}" for k in rng.sample(range(12), 5)}
        old = {k: model[k] for k in new if k in model}
        shown = identity.changed_hash(shown, full(new.values()), full(old.values()))
        model |= new
        assert shown == full(model.values())
    assert identity.changed_hash(shown, "", full(model.values())) == "" and full([*model.values(), "x", "x"]) != full([*model.values(), "x"])


def page(name, body, hours=0):
    return ("s", name, f"wiki/{name}.md", name.upper(), body, str(hash(body)), [], True, dt.datetime(2026, 1, 1) + dt.timedelta(hours=hours))


def test_the_projection_advances_as_a_rebuild_would(spark, tmp_path):
    rng, ledger, now, model = random.Random(2), L.Ledger(spark, str(tmp_path)), dt.datetime(2026, 1, 1), {}
    words = ["copper", "ledger", "quartz", "tin", "zinc", "[[a]]", "[[b]]"]
    P.ensure(ledger, "s", spark.createDataFrame([], PAGES), "d", now)
    for step in range(4):
        new = {k: page(k, " ".join(rng.choices(words, k=rng.randrange(1, 12))), step) for k in rng.sample("abcdefgh", 3)}
        tx = ledger.begin()
        state = P.advance(tx, "s", spark.createDataFrame(list(new.values()), PAGES), "d", now)
        tx.commit()
        model |= new
        pages = spark.createDataFrame(list(model.values()), PAGES)
        assert P.is_current(ledger, "s", pages, "d") and state["page_count"] == len(model)
        assert sorted(ledger.get("links", P.LINKS).collect()) == sorted(wiki_links(pages).collect())
        for terms in (["copper"], ["copper", "ledger", "a"], ["zinc", "tin", "b", "none"]):
            want = [tuple(r) for r in search.ranked(search.matches(pages, terms), len(set(terms)), 4).select("page_id", "strict", "score").collect()]
            got = [tuple(r) for r in P.index(ledger).best("s", terms, 4).orderBy("place").select("page_id", "strict", "score").collect()]
            # the scan counts an absent term among those to hold, the index too
            assert [(i, x, pytest.approx(y, abs=2e-6)) for i, x, y in want] == got


def engine_of(spark, tmp_path, **more):
    return Engine(spark, str(tmp_path), "s", maintainer, clock=Clock(), **more)


def test_a_crash_between_any_two_writes_leaves_one_whole_version(spark, tmp_path, monkeypatch):
    engine = engine_of(spark, tmp_path)
    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    engine.preview(operation)
    write, version, n = L.Ledger._write, engine.ledger.version(), 0
    while True:
        left = n

        def failing(self, table, df):
            nonlocal left
            # the apply lease is a version of its own, taken before the commit's writes
            if table != "operations" or left < n:
                left -= 1
            if left < 0:
                raise OSError("the disk is full")
            return write(self, table, df)

        monkeypatch.setattr(L.Ledger, "_write", failing)
        try:
            engine.apply(operation)
        except OSError:
            monkeypatch.setattr(L.Ledger, "_write", write)
            seen = engine_of(spark, tmp_path)
            assert seen.files().count() == 0 and seen.pages().count() == 0 and seen.operation(operation)["status"] == "running"
            seen.clock.now = engine.clock.now + dt.timedelta(seconds=1000)  # the lease runs out
            engine, n = seen, n + 6
            continue
        break
    monkeypatch.setattr(L.Ledger, "_write", write)
    assert n > 6 and engine.operation(operation)["status"] == "completed" and engine.ledger.version() > version
    assert [r.page_id for r in engine.retrieve("lease").hits.collect()] == ["notes/lease"]
    assert not {r.code for r in engine.lint().collect()} & {"projection.drift", "log.malformed"}


def test_an_active_apply_lease_keeps_others_out_and_an_expired_one_is_taken_over(spark, tmp_path):
    calls = []

    def counted(*given):
        calls.append(1)
        return maintainer(*given)

    engine = Engine(spark, str(tmp_path), "s", counted, clock=Clock())
    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    engine.preview(operation)
    engine.operations.lease(operation, engine.clock(), 300)
    with pytest.raises(LeaseHeld):
        engine.run(operation)
    assert engine.operation(operation)["status"] == "running" and engine.files().count() == 0
    engine.clock.now += dt.timedelta(seconds=400)
    assert engine.run(operation) == "committed" == engine.run(operation) == engine.apply(operation) and len(calls) == 1
    assert engine.operations.row(operation).plan_digest == engine.operation(operation)["generation"]


def test_a_fenced_commit_does_not_become_visible(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    engine.preview(operation)
    staged = L.Ledger._write

    def slow(self, table, df):
        if table == "log":  # while this runner writes, its lease runs out and another takes the operation over
            L.Ledger._write = staged
            engine.operations.lease(operation, engine.clock() + dt.timedelta(seconds=1000), 300)
        return staged(self, table, df)

    L.Ledger._write = slow
    try:
        with pytest.raises(LeaseHeld):
            engine.apply(operation)
    finally:
        L.Ledger._write = staged
    assert engine.files().count() == 0 and engine.operation(operation)["status"] == "running"


def test_a_changed_schema_and_a_missing_stage_end_the_operation(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    one, two = (engine.ingest("a", x, "1", f"# {x}".encode()) for x in ("lease", "other"))
    engine.preview(one)
    engine.operations.move(two, "plan", engine.now(), plan_digest="gone")
    later = engine_of(spark, tmp_path, schema="# Schema\nversion: 2\n")
    assert later.run(one) == "failed" and later.operation(one)["failure_class"] == "stale"
    assert later.run(two) == "failed" and later.operation(two)["failure_class"] == "staging"


def test_a_lost_work_lease_stops_a_run_between_its_steps(spark, tmp_path):
    engine, asked = engine_of(spark, tmp_path), []

    def held():
        asked.append(1)
        return len(asked) < 3

    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    with pytest.raises(Cancelled):
        engine.run(operation, held)
    assert engine.operation(operation)["status"] == "running" and engine.files().count() == 0
    assert engine.run(operation) == "committed"


def test_the_scheduler_cancels_what_it_has_lost(spark, tmp_path, monkeypatch):
    import threading

    planning, go_on = threading.Event(), threading.Event()

    def waits(*given):
        planning.set()
        assert go_on.wait(240)
        return maintainer(*given)

    engine = Engine(spark, str(tmp_path), "s", waits, clock=Clock())
    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    scheduler = engine.scheduler(scan=0.1, lease=0.3)
    monkeypatch.setattr(engine.operations, "renew", lambda *given: not planning.is_set())
    told = threading.Event()
    lost, scheduler._lost = scheduler._lost, lambda i: (lost(i), told.set())
    scheduler.start()
    assert planning.wait(240) and told.wait(240)
    go_on.set()
    assert scheduler.stop(240)
    assert [(i, type(e)) for i, e in scheduler.errors] == [(operation, Cancelled)]
    assert engine.operation(operation)["status"] == "queued" and engine.files().count() == 0
    # a job that is cancelled ends the run in the same way
    monkeypatch.setattr(engine, "run", lambda i, held: (lost(i), 1 / 0))
    again = engine.scheduler()
    lost = again._lost
    again._guarded(operation, "token")
    assert [(i, type(e)) for i, e in again.errors] == [(operation, Cancelled)]


def test_lint_tells_a_source_that_was_changed(spark, tmp_path):
    from loamstack.engine import SOURCES

    engine = engine_of(spark, tmp_path)
    engine.ingest("a", "lease", "1", b"text")
    engine.ledger.put("sources", engine.ledger.get("sources", SOURCES).withColumn("content", F.lit(b"other")))
    assert "raw.source_digest_mismatch" in {r.code for r in engine.lint().collect()}


def test_one_version_of_the_index_reads_no_text(spark, tmp_path):
    from loamstack.plans import views

    ledger = L.Ledger(spark, str(tmp_path))
    pages = views.pages(spark, "/root/testdata/sf0.001").withColumn("scope", F.lit("s"))
    P.ensure(ledger, "s", pages, "d", dt.datetime(2026, 1, 1))
    found = P.index(ledger)
    plan = found.best("s", ["the", "of"], 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan and "source_refs" not in plan
    hits = I.search(found, ledger.get("pages", PAGES), "s", ["the", "of"], 5, 64)
    scan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(page_id, [" in scan and "EqualTo(scope,s)" in scan
    want = search.search(pages, "s", ["the", "of"], 5, 64)
    assert [tuple(r) for r in hits.select("page_id", "snippet", "strict", "score").collect()] == [tuple(r) for r in want.select("page_id", "snippet", "strict", "score").collect()]


def test_ordered_text_in_parts(spark, tmp_path):
    from loamstack.sinks import text

    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.concat(F.lit("line "), F.col("id") * 7919 % 5003).alias("line")).repartition(7)
    text.write_ordered(rows, ["k"], "line", str(tmp_path / "log"), heading="# Log")
    parts = sorted((tmp_path / "log").glob("part-*"))
    want = [f"line {k}" for k in sorted(i * 7919 % 5003 for i in range(5000))]
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == ["# Log", *want]
    got = text.numbered(rows, ["k"], str(tmp_path / "lines")).orderBy("line_no").collect()
    assert [r.line for r in got] == want and [r.line_no for r in got] == list(range(1, 5001))
    assert text.numbered(rows.limit(0), ["k"], str(tmp_path / "none")).count() == 0
