import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from loamstack.engine import Engine
from loamstack.functions import times
from loamstack.operators import edits, evidence
from loamstack.sinks import commit as C
from loamstack.sinks.ledger import Ledger
from loamstack.sources import bootstrap, workspace
from loamstack.streaming.scheduler import Scheduler
from tests.test_engine import Clock, maintainer


def test_times(spark):
    rows = spark.createDataFrame([("2026-01-01T00:00:00.123456789Z",), ("2026-01-01T02:00:00+02:00",), ("x",)], "t string").select(times.written(times.parsed(F.col("t")))).collect()
    assert [r[0] for r in rows] == ["2026-01-01T00:00:00.123456Z", "2026-01-01T00:00:00Z", None]
    assert spark.range(1).select(times.after(F.lit(dt.datetime(2026, 1, 1)), 1.5)).first()[0] == dt.datetime(2026, 1, 1, 0, 0, 1, 500000)


def test_last_plan_that_decodes_wins(spark):
    good = lambda p: json.dumps({"schema_digest": "s", "source_refs": ["a"], "rationale": "", "edits": [{"path": p, "expected_digest": "", "content": ""}]})
    rows = [("r", 0, good("one")), ("r", 1, good("two")), ("r", 2, "noise"), ("r", 3, good("three") + " x"), ("r", 4, good("four") + "," + good("five")), ("r", 5, '{"edits": "none"}'), ("q", 0, "noise"), ("e", 0, ""), ("e", 1, None), ("o", 0, good("big")), ("o", 1, "x" * 300), ("u", 0, '{"schema_digest": "s", "edits": [], "other": {"a": 1}}')]
    frame = spark.createDataFrame(rows, "run string, line_no int, line string")
    got = {r.run: r for r in edits.decoded_plans(frame, 500).collect()}
    assert {k: r.failure for k, r in got.items()} == {"r": "oversized" if sum(len(x[2]) for x in rows[:6]) > 500 else None, "q": "malformed", "e": "empty", "o": None if len(rows[9][2]) + 300 <= 500 else "oversized", "u": None}
    assert {r.run: r.plan.edits[0].path for r in edits.decoded_plans(frame).collect() if r.plan and r.plan.edits} == {"r": "two", "o": "big"}
    assert edits.decoded_plans(frame, 100).where("run = 'o'").first().failure == "oversized"


def test_output_lines_of_a_model_process_are_a_plan(spark, tmp_path):
    made = []

    def lines(source, context, schema):
        plan = maintainer(source, context, schema)
        made.append(json.dumps({"schema_digest": plan.schema_digest, "source_refs": plan.source_refs, "edits": [dict(zip(("path", "expected_digest", "content"), e, strict=True)) for e in plan.edits]}))
        return ["thinking", made[-1]] if source["source_id"] == "lease" else ["nothing"]

    engine = Engine(spark, str(tmp_path), "s", lines, clock=Clock())
    one, two = engine.ingest("a", "lease", "1", b"# Lease\nten seconds"), engine.ingest("a", "store", "1", b"# Store")
    assert engine.run(one) == "committed" and engine.run(two) == "failed"
    assert engine.operation(two)["failure_class"] == "plan"


def test_prospective_findings(spark):
    given = spark.createDataFrame([("wiki/a.md", "---\nid: a\ntitle: A\ntype: note\nsource_refs: [s]\n---\n[[b]] [[zz]]"), ("wiki/b.md", "bare")], "path string, content string")
    found = edits.prospective_findings(given, spark.createDataFrame([("c",)], "page_id string"), spark.createDataFrame([("s",)], "ref string"))
    assert [(r.code, r.page_id) for r in found.collect()] == [("frontmatter.malformed", "b"), ("link.broken", "a")]


def test_stage_review_apply(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), "s", maintainer, clock=Clock())
    operation = engine.ingest("a", "lease", "1", b"# Lease\nten seconds")
    name = engine.preview(operation)
    assert engine.preview(operation) == name and engine.files().count() == 0
    assert engine.operation(operation)["status"] == "running"
    assert engine.run(operation) == "committed" and engine.operation(operation)["generation"] == name
    assert json.loads(evidence.encoded(engine.retrieve("lease")).first()[0])["evidence"][0]["page_id"] == "notes/lease"
    filed = engine.file("lease")
    assert filed.startswith("s:query:result-") and engine.file("lease") == filed


def test_a_changed_stage_is_refused(spark, tmp_path):
    store = Ledger(spark, str(tmp_path))
    frame = spark.createDataFrame([("wiki/a.md", "", "x")], "path string, expected_digest string, content string")
    C.stage(store, frame, "o", "s", ["r"])
    assert C.load_stage(store, "o", "s").count() == 1 and C.load_stage(store, "none", "s") is None
    with pytest.raises(C.BrokenStage):
        C.load_stage(store, "o", "other")
    rows = store.get("stages", C.struct(C.STAGE))
    store.put("stages", rows.withColumn("content", F.lit("y")))
    with pytest.raises(C.BrokenStage):
        C.load_stage(store, "o", "s")
    C.discard_stages(store, spark.createDataFrame([], "operation_id string"))
    assert C.load_stage(store, "o", "s") is None


def test_evaluation(spark):
    expected = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c")], "query string, page_id string")
    results = spark.createDataFrame([("q1", "a"), ("q1", "z"), ("q2", "b"), ("q3", "a")], "query string, page_id string")
    assert tuple(evidence.evaluated(results, expected).first()) == (3, 2, False)
    assert tuple(evidence.evaluated(results, expected, 0.6).first()) == (3, 2, True)


def test_trees_and_workspaces(spark, tmp_path):
    (tmp_path / "notes/sub").mkdir(parents=True)
    (tmp_path / "notes/sub/a.md").write_text("x")
    assert [r.path for r in bootstrap.tree(spark, str(tmp_path / "notes")).collect()] == ["sub/a.md"]
    root = str(tmp_path / "ws")
    assert set(workspace.missing(spark, root)) >= {"raw", "wiki"}
    assert "schema.md" in workspace.init(spark, root) and workspace.init(spark, root) == [] and workspace.missing(spark, root) == []


def test_scheduler():
    todo, ran, renewed, over = [f"o{i}" for i in range(5)], [], [], threading.Event()

    def claim(n):
        took, todo[:] = todo[:n], todo[n:]
        return "t", took

    def run(i):
        over.wait(0.05)
        ran.append(i)
        if i == "o1":
            raise RuntimeError("no")

    s = Scheduler(claim, run, lambda i, t: renewed.append(i) or True, scan=30, lease=0.03, batch=2).start()
    s.wake()
    s.wake()
    for _ in range(100):
        if len(ran) == 5:
            break
        over.wait(0.05)
    assert s.stop() and ran == [f"o{i}" for i in range(5)] and set(renewed) == set(ran) and [i for i, _ in s.errors] == ["o1"]
