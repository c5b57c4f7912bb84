"""Findings from counts that edits change against lint over all texts."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from loamstack.engine import Engine, Plan
from loamstack.functions.markdown import wiki_links
from loamstack.model import PAGES
from loamstack.operators import lint, refcounts
from loamstack.sinks import ledger as L
from loamstack.sinks import projection as P

CODES = ["index.broken_page", "index.missing_page", "page.orphan", "link.broken"]


def page(name, body, k=0):
    return ("s", name, f"wiki/{name}.md", name, body, str(k), [], True, dt.datetime(2026, 1, 1))


def plain(findings):
    return sorted(map(str, findings.where(F.col("code").isin(CODES)).collect()))


def test_findings_after_random_edits(spark, tmp_path):
    draw, ledger, now = random.Random(5), L.Ledger(spark, str(tmp_path)), dt.datetime(2026, 1, 1)
    text = lambda: " ".join(f"[[p{draw.randrange(9)}]]" for _ in range(draw.randrange(4)))
    listing = lambda x: spark.createDataFrame([("s", x)], "scope string, body string")
    index = "- p1\n- p1\n- p7\n[[gone]] [[gone]]"
    held = {n: page(n, text()) for n in ("p1", "p2", "p3")}
    P.ensure(ledger, "s", spark.createDataFrame([*held.values()], PAGES), "d", now, listing(index))
    for k in range(3):
        new = {n: page(n, text(), k) for n in draw.sample([f"p{i}" for i in range(8)], 2)}
        after = "\n".join(f"- p{draw.randrange(9)}" for _ in range(4)) if k % 2 else index
        tx = ledger.begin()
        P.advance(tx, "s", spark.createDataFrame([*new.values()], PAGES), "d", now, (listing(index), listing(after)) if k % 2 else None)
        tx.commit()
        held, index = held | new, after
        pages = spark.createDataFrame([*held.values()], PAGES)
        want = lint.link_findings(pages, wiki_links(pages), listing(index))
        got = refcounts.counted_findings(ledger.get("counts", refcounts.COUNTS), ledger.get("links", P.TABLES["links"][0]))
        assert plain(got) == plain(want)
    summed = plain(got)
    for k in range(L.MANY_SEGMENTS):
        tx = ledger.begin()
        tx.append("counts", spark.createDataFrame([], refcounts.COUNTS))
        tx.commit()
    assert "counts" in P.tidy(ledger)
    counts = ledger.get("counts", refcounts.COUNTS)
    assert counts.groupBy("scope", "page_id").count().where("count > 1").isEmpty() and counts.where("present < 0").isEmpty()
    assert plain(refcounts.counted_findings(counts, ledger.get("links", P.TABLES["links"][0]))) == summed


def test_counts_of_nothing_and_of_null_texts(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    nothing = refcounts.contributions(none, refcounts.listed(none))
    assert nothing.isEmpty() and refcounts.counted_findings(nothing, wiki_links(none)).isEmpty()
    one = spark.createDataFrame([page("a", None)], PAGES)
    found = refcounts.counted_findings(refcounts.contributions(one, refcounts.listed(none)), wiki_links(one))
    assert sorted(r.code for r in found.collect()) == ["index.missing_page", "page.orphan"]


def test_engine_keeps_the_counts(spark, tmp_path):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    note = lambda name, ref, rest: f"---\nid: {name}\ntitle: T\ntype: note\nsource_refs: ['{ref}']\n---\n{rest}\n"
    first_index, a = "# Index\n- a\n- lost\n", note("a", "t:0@1", "[[b]]")

    def maintainer(source, context, schema):
        edits = {
            "0": [("wiki/a.md", "", a), ("wiki/b.md", "", note("b", "t:0@1", "")), ("wiki/index.md", "", first_index)],
            "1": [("wiki/a.md", digest(a), note("a", "t:0@1", "none")), ("wiki/index.md", digest(first_index), "# Index\n- lost\n- gone [[x")],
        }
        return Plan(engine.schema_digest, [source["ref"]], edits[source["source_id"]])

    engine, seen = Engine(spark, str(tmp_path), "s", maintainer), []
    for k in range(2):
        assert engine.run(engine.ingest("t", str(k), "1", b"text")) == "committed"
        whole = engine.lint().where(F.col("code").isin([*CODES, "index.malformed"])).collect()
        assert sorted(map(str, engine.lint_links().collect())) == sorted(map(str, whole))
        seen.append(sorted(r.code for r in whole))
    assert seen == [["index.broken_page", "index.missing_page"], ["index.broken_page", "index.broken_page", "index.malformed", "index.missing_page", "index.missing_page", "page.orphan", "page.orphan"]]
