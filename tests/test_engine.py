import datetime as dt

import pytest

from loamstack.engine import Engine, Plan
from loamstack.model import SourceConflict
from loamstack.sinks import projection
from loamstack.sinks.ledger import Ledger

SOURCES = [("lease", "# Lease policy\nLeases renew every ten seconds and expire after thirty."), ("store", "# Storage choice\nThe embedded ledger keeps session memory durable."), ("lease", "# Lease policy\nLeases now expire after sixty seconds, see storage.")]


def maintainer(source, context, schema):
    """Keeps one page for each source id."""
    import hashlib

    path = f"wiki/notes/{source['source_id']}.md"
    old = next((p for p in context if p["path"] == path), None)
    link = "\nSee [[notes/lease]]." if source["source_id"] == "store" else ""
    refs = sorted({source["ref"], *(old["source_refs"] if old else [])})
    text = f"---\nid: notes/{source['source_id']}\ntitle: {source['title'].lstrip('# ')}\ntype: note\nsource_refs: {refs}\n---\n{source['text']}{link}\n"
    return Plan(hashlib.sha256(schema.encode()).hexdigest(), [source["ref"]], [(path, old["digest"] if old else "", text)])


class Clock:
    def __init__(self):
        self.now = dt.datetime(2026, 1, 1)

    def __call__(self):
        self.now += dt.timedelta(seconds=1)
        return self.now


def test_knowledge_loop(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), "team", maintainer, clock=Clock())
    assert engine.retrieve("lease").hits.count() == 0
    for version, (name, text) in enumerate(SOURCES):
        operation = engine.ingest("adr", name, str(version), text.encode())
        assert engine.operation(operation)["status"] == "queued"
        assert engine.ingest("adr", name, str(version), text.encode()) == operation
        assert engine.run_ready() == [operation]
        assert engine.operation(operation)["status"] == "completed", engine.operations.table().collect()
    with pytest.raises(SourceConflict):
        engine.ingest("adr", "lease", "0", b"other")
    found = engine.retrieve("When do leases expire?")
    top = found.hits.first()
    assert top.page_id == "notes/lease" and "sixty" in top.snippet
    assert ("raw", "adr:lease@2", "notes/lease") in [tuple(r) for r in found.citations.collect()]
    assert ("notes/store", "notes/lease", "wiki") in [tuple(r) for r in found.links.collect()]
    codes = {r.code for r in engine.lint().collect()}
    assert codes == {"index.missing_page", "page.orphan"} or codes == {"index.missing_page"} | ({"page.orphan"} & codes)
    again = Engine(spark, str(tmp_path), "team", maintainer, clock=Clock())
    assert [r.snippet for r in again.retrieve("When do leases expire?").hits.collect()] == [r.snippet for r in found.hits.collect()]
    other = Engine(spark, str(tmp_path), "rival", maintainer, clock=Clock())
    assert other.retrieve("leases").hits.count() == 0


@pytest.mark.parametrize("edit,kind", [(("wiki/log.md", "", "x"), "plan"), (("wiki/a.md", "0" * 64, "x"), "stale"), (("wiki/a.md", "", "[[gone]]"), "content"), (("wiki/a.md", "", "no frontmatter"), "content"), (("wiki/a.md", "", "---\nid: a\ntitle: T\ntype: note\nsource_refs: ['a:none@1']\n---\nx"), "content")])
def test_rejected_plans_leave_the_pages_alone(spark, tmp_path, edit, kind):
    def bad(source, context, schema):
        import hashlib

        return Plan(hashlib.sha256(schema.encode()).hexdigest(), [source["ref"]], [edit])

    engine = Engine(spark, str(tmp_path), "s", bad, clock=Clock())
    operation = engine.ingest("a", "1", "1", b"text")
    engine.run_ready()
    assert engine.operation(operation) == {"operation_id": operation, "status": "failed", "failure_class": kind, "generation": None}
    assert engine.files().count() == 0 and engine.run(operation) == "failed"


def test_projection_is_rebuilt_by_scope(spark, tmp_path):
    from loamstack.plans import views

    store, now = Ledger(spark, str(tmp_path)), dt.datetime(2026, 1, 1)
    pages = views.pages(spark, "/root/testdata/sf0.001")
    for scope in ("src0", "src1"):
        assert projection.ensure(store, scope, pages.where(f"scope = '{scope}'"), "d", now)
    one = {r.scope: r.n for r in store.get("pages", projection.PAGES).groupBy("scope").count().withColumnRenamed("count", "n").collect()}
    assert set(one) == {"src0", "src1"}
    assert projection.is_current(store, "src0", pages.where("scope = 'src0'").orderBy("page_id", ascending=False), "d")
    assert not projection.is_current(store, "src0", pages.where("scope = 'src0'").limit(1), "d")
    assert projection.ensure(store, "src0", pages.limit(0), "d", now)
    assert {r.scope for r in store.get("pages", projection.PAGES).collect()} == {"src1"}


def test_bootstrap(spark, tmp_path):
    files = [("Alpha.md", "---\ntags: [x]\n---\n# Alpha page\n[[Beta|Second]] ![[diagram.png]] [[lost]]"), ("sub/Beta.md", "plain [[Alpha#Top]] and ![[nothing]]"), ("img/diagram.png", "png"), (".obsidian/app.md", "hidden")]
    frame = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files], "path string, content binary")
    engine = Engine(spark, str(tmp_path), "s", clock=Clock())
    assert engine.bootstrap(frame) == {"notes": 2, "assets": 1}
    got = {r.path: r.content for r in engine.files().collect()}
    assert "[[notes/sub/Beta|Second]]" in got["wiki/notes/Alpha.md"] and "![](../assets/img/diagram.png)" in got["wiki/notes/Alpha.md"] and "[[lost]]" in got["wiki/notes/Alpha.md"]
    assert "tags:" in got["wiki/notes/Alpha.md"] and "title: Alpha page" in got["wiki/notes/Alpha.md"]
    assert "[[notes/Alpha#Top]]" in got["wiki/notes/sub/Beta.md"] and "![unsupported obsidian embed](nothing)" in got["wiki/notes/sub/Beta.md"]
    assert "- [[notes/Alpha|Alpha page]]" in got["wiki/index.md"]
    assert engine.retrieve("alpha").hits.count() >= 1
    assert [(r.path, bytes(r.content)) for r in engine.assets().collect()] == [("wiki/assets/img/diagram.png", b"png")]
    with pytest.raises(RuntimeError):
        engine.bootstrap(frame)


@pytest.mark.parametrize("one, other, meet", [("/a/b", "/a/b/", True), ("/a/b", "/a/b/c", True), ("file:///a/b/c", "/a/b", True), ("/a/b", "/a/bc", False), ("/a/b c", "/a/b c/d", True)])
def test_an_import_does_not_overlap_its_store(spark, one, other, meet):
    from loamstack.sources.bootstrap import require_disjoint

    if meet:
        with pytest.raises(ValueError):
            require_disjoint(spark, one, other)
    else:
        require_disjoint(spark, one, other)


def test_workspace_scan(spark, tmp_path):
    import hashlib

    from loamstack.sources import workspace as W

    root = tmp_path / "ws"
    (root / "wiki/a").mkdir(parents=True)
    (root / "wiki/a/p.md").write_text("---\nid: a/p\nsource_refs: [x:1@1]\n---\n# Title\n")
    (root / "wiki/index.md").write_text("- a/p\n")
    (root / "schema.md").write_text("# S\nschema_version: 7\n")
    for name, text, digest in [("ok", "src", hashlib.sha256(b"src").hexdigest()), ("bad", "src", "0" * 64), ("nosource", None, "0" * 64), ("nomanifest", "src", None), ("foreign", "src", "0" * 64)]:
        (root / "raw" / name / "v").mkdir(parents=True)
        if text:
            (root / "raw" / name / "v/source").write_text(text)
        if digest:
            (root / "raw" / name / "v/manifest.yaml").write_text(f"scope: {'r' if name == 'foreign' else 's'}\nadapter: x\nid: {name}\nversion: '1'\ndigest: {digest!r}\nmedia_type: text/plain\n")
    pages = W.wiki_pages(spark, str(root), "s").collect()
    assert [(p.page_id, p.path, p.title, p.source_refs) for p in pages] == [("a/p", "wiki/a/p.md", "Title", ["x:1@1"])]
    assert {r.path.split("/")[1]: r.error_class for r in W.raw_records(spark, str(root), "s").collect()} == {"ok": None, "bad": "source_digest_mismatch", "nosource": "source_missing", "nomanifest": "manifest_missing"}
    assert W.control_page(spark, str(root), "index").first().body == "- a/p\n"
    assert W.schema_document(spark, str(root))["version"] == "7"
    assert W.read_source(spark, str(root), "raw/ok/v", hashlib.sha256(b"src").hexdigest()) == b"src"
