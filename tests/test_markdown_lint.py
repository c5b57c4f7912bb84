import json

import pytest
from pyspark.sql import functions as F

from loamstack.functions import identity as I
from loamstack.functions import markdown as M
from loamstack.operators import lint


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(f(F.col("t"))).collect()]


def test_targets(spark):
    texts = ["[[a]] [[wiki/b.md|label]] [[c#part]]", "[[ spaced ]] [[../up]] [[/abs]] [[x/../y]] [[.]] [[]]", "[[open", "[[a]] [[open", "", None, "[[a\nb]]"]
    assert col(spark, texts, M.targets) == [["a", "b", "c"], ["spaced"], [], ["a"], [], [], ["a\nb"]]
    assert col(spark, texts, M.unclosed) == [False, False, True, True, False, False, False]


def test_index_targets(spark):
    assert col(spark, ["- a\n  - wiki/b.md \n* c\n- [[d|D]]\n-e"], M.index_targets) == [["d", "a", "b", "[[d|D]]"]]


def test_titles(spark):
    texts = ["\n  ## Two \n# One", "first line\nsecond", "#no\n####### seven", "", "#\t tab", "x" * 300]
    assert col(spark, texts, M.source_title) == ["Two", "first line", "#no", "", "tab", "x" * 256]
    assert col(spark, ["a\n # T \n# U", "## no"], M.page_title) == ["T", ""]


def test_page_ids_and_edit_paths(spark):
    paths = ["wiki/a/b.md", "wiki/index.md", "wiki/log.md", "wiki/.md", "raw/a.md", "wiki/../a.md", " wiki/a.md ", "wiki/a.txt", "wiki/wiki/a.md", "wiki\\a.md"]
    assert col(spark, paths, M.page_id) == ["a/b", None, None, None, None, None, "a", None, None, "a"]
    edits = ["wiki/a.md", "wiki/index.md", "wiki/log.md", "wiki/../a.md", "wiki/a/./b.md", "/wiki/a.md", "wiki//a.md", "wiki/a.txt", None]
    assert col(spark, edits, M.safe_edit_path) == [True, True, False, False, False, False, False, False, False]


def test_frontmatter(spark):
    good = "---\nid: a \ntitle: T\ntype: note\nsource_refs: [x:1@1, 'y:2@2 ']\ntags: [q]\n---\nbody"
    rows = col(spark, [good, "no", "---\nid: a\n", "---\nid: [\n---\n", "---\n---\nb", None, "---\n- list\n---\n"], M.frontmatter)
    assert [r.ok for r in rows] == [True, False, False, False, True, False, False]
    assert (rows[0].id, rows[0].title, rows[0].type, rows[0].source_refs, json.loads(rows[0].extras)) == ("a", "T", "note", ["x:1@1", "y:2@2"], {"tags": ["q"]})


def test_only_the_leading_block_goes_to_python(spark):
    import pandas as pd

    long = "x" * 50_000 + "\n---\n" + "y\n" * 1000
    texts = [
        "---\nid: a\n---\n" + long, " --- \r\nid: a\r\n---\r\nbody", "---\nid: a\n\u00a0---\n" + long, "no\n---\nid: a\n---\n", "---", "---\n", "---\n---", "---\n---\n", "---\n---\nbody",
        "---\nid: a\n--- x\n---\n", "----\nid: a\n---\n", "---\nid: a\n----\n---", "\n---\nid: a\n---\n", "---\r\n---\r\n", "---\nid: [\n---\nrest", "---\nid: a", "\u2003---\nid: b\n---", None, "", "a --- b\nid: a\n---\n" + long,
    ]
    got = [tuple(r) for r in col(spark, texts, M.frontmatter)]
    whole = M._frontmatter.func(pd.Series(texts, dtype=object))
    assert got == [tuple(r) for r in whole.itertuples(index=False)]
    assert max(map(len, col(spark, ["---\nid: a\n---\n" + long, "no\n" + long, long], M.leading))) == 14


def test_identities(spark):
    row = spark.range(1).select(I.source_ref(F.lit("a"), F.lit("i"), F.lit("v")), I.operation_id(F.lit("s"), F.lit("a"), F.lit("i"), F.lit("v"), F.lit("d" * 64)), I.inline_id(F.lit(" "), F.lit("k"), F.lit("e" * 64)), I.inline_version(F.lit(None).cast("string"), F.lit("e" * 64)), I.is_digest(F.lit("A" * 64)), I.is_digest(F.lit("g" * 64)), I.failure_class(F.lit("source: not there"))).first()
    assert tuple(row) == ("a:i@v", "s:a:i@v#" + "d" * 16, "k", "sha256-" + "e" * 16, True, False, "source")


PAGES = [
    ("a", "wiki/a.md", "---\nid: a\ntitle: A\ntype: note\nsource_refs: ['s:1@1']\n---\n[[b]]"),
    ("b", "wiki/b.md", "---\nid: other\nsource_refs: ['s:9@1']\n---\n[[gone]] [[open"),
    ("b", "wiki/b2.md", "none"),
    ("c", "wiki/c.md", "---\ntitle: C\ntype: note\n---\n[[c]]"),
]


def test_page_and_link_rules(spark):
    pages = spark.createDataFrame(PAGES, "page_id string, path string, body string")
    refs = spark.createDataFrame([("s:1@1",)], "ref string")
    index = spark.createDataFrame([("- a\n- missing\n[[b",)], "body string")
    links = M.wiki_links(pages.withColumn("scope", F.lit("s"))).select("from_page", "to_page")
    found = lint.page_findings(pages, lint.parsed(pages), refs).unionByName(lint.link_findings(pages, links, index))
    got = sorted((r.code, r.path, r.page_id) for r in lint.ordered(found).collect() if r.path)
    assert got == sorted([
        ("page.duplicate_id", "wiki/b2.md", "b"), ("frontmatter.malformed", "wiki/b2.md", "b"), ("frontmatter.id_mismatch", "wiki/b.md", "b"), ("frontmatter.title_missing", "wiki/b.md", "b"), ("frontmatter.type_missing", "wiki/b.md", "b"),
        ("citation.unknown_source", "wiki/b.md", "b"), ("frontmatter.id_missing", "wiki/c.md", "c"), ("citation.missing", "wiki/c.md", "c"), ("link.malformed", "wiki/b.md", "b"), ("index.malformed", "wiki/index.md", None),
        ("index.broken_page", "wiki/index.md", "missing"), ("index.missing_page", "wiki/index.md", "b"), ("index.missing_page", "wiki/index.md", "b"), ("index.missing_page", "wiki/index.md", "c"),
    ])
    assert [(r.page_id, r.refs) for r in found.where("code = 'link.broken'").collect()] == [("b", ["gone"])]
    assert tuple(lint.healthy(found).first())[0] is False
    assert tuple(lint.healthy(found.limit(0)).first()) == (True, 0, 0, 0)


def test_raw_rules(spark):
    rows = [("raw/1", "s:1@1", "d1", True, None), ("raw/2", "s:1@1", "d2", True, None), ("raw/3", None, None, False, "source_missing"), ("raw/4", None, None, False, "")]
    found = lint.raw_findings(spark.createDataFrame(rows, "path string, ref string, digest string, valid boolean, error_class string"))
    assert sorted((r.code, r.path) for r in found.collect()) == [("raw.duplicate_identity", "raw/2"), ("raw.manifest_invalid", "raw/4"), ("raw.source_missing", "raw/3")]


def test_log_rules(spark):
    entry = lambda **x: "- " + json.dumps({"operation_id": "o", "generation": "g", "schema_digest": "s", "source_refs": [], "files": ["a", "b"]} | x)
    body = "\n".join(["# Log", "", entry(), entry(files=["b", "a"]), entry(operation_id="p", schema_digest="t"), "text", "- {", entry(operation_id=""), entry(operation_id="q", files=["zz"])])
    found = lint.log_findings(lint.text_lines(spark.createDataFrame([(body,)], "body string")), "s", spark.createDataFrame([("a",), ("b",)], "path string"))
    assert sorted((r.code, r.path) for r in found.collect()) == [("log.duplicate_operation", "wiki/log.md"), *[("log.malformed", "wiki/log.md")] * 3, ("log.missing_file", "zz"), ("log.order", "wiki/log.md"), ("log.schema_mismatch", "wiki/log.md")]
    assert sorted(r.message for r in found.where("code = 'log.malformed'").collect()) == ["log contains a non-structured entry"] + ["log entry is not a complete structured commit record"] * 2


def test_suggestions(spark):
    none = spark.createDataFrame([], "code string, severity string, path string, page_id string, message string, refs array<string>")
    assert lint.suggestions(none).count() == 0
    first = lambda suggest: tuple(lint.suggestions(none, suggest).first())[:3]
    assert first(lambda seen: ["wiki/a.md"]) == ("lint.suggestion", "info", "wiki/a.md")
    assert first(lambda seen: 1 / 0) == ("lint.provider_failed", "warning", None)
    assert first(lambda seen: {}["schema"]) == ("lint.provider_unavailable", "warning", None)
    assert tuple(lint.projection_unavailable(spark).first())[:2] == ("projection.unavailable", "info")


@pytest.mark.parametrize("digest,n", [("x", 0), ("y", 1)])
def test_projection_rule(spark, digest, n):
    state = spark.createDataFrame([("x",)], "snapshot_digest string")
    assert lint.projection_finding(state, digest).count() == n
    assert lint.projection_finding(state.limit(0), digest).count() == 1
