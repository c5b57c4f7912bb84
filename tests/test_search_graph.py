import datetime as dt

import pytest

from loamstack.model import PAGES, InvalidQuery, InvalidScope, LimitExceeded, ReadLimits
from loamstack.operators import evidence, graph, search

T0 = dt.datetime(2026, 1, 1)


def page(scope, name, title, body, hours=0, refs=()):
    return (scope, name, f"wiki/{name}.md", title, body, "0" * 64, list(refs), True, T0 + dt.timedelta(hours=hours))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        page("s", "both", "Storage", "the copper engine keeps a tidy ledger", 1, ["a:1@1"]),
        page("s", "copper-only", "Metals", "copper conducts", 2),
        page("s", "ledger-only", "Books", "a ledger lists entries", 3, ["a:2@1", "a:1@1"]),
        page("s", "in-title", "Quartz resonance", "nothing else here", 4),
        page("s", "in-body", "Other", "quartz has a resonance", 5),
        page("s", "tie-1", "Same", "twinword", 6),
        page("s", "tie-2", "Same", "twinword", 7),
        page("s", "kyrillisch", "Хранилище", "Баджер пишет", 8),
        page("other", "foreign", "Copper ledger", "copper ledger copper ledger", 9),
    ]
    return spark.createDataFrame(rows, PAGES).cache()


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([("s", "both", "copper-only", "wiki"), ("s", "tie-1", "both", "wiki"), ("s", "copper-only", "tie-2", "wiki"), ("s", "both", "gone", "wiki"), ("s", "both", "both", "wiki"), ("other", "both", "foreign", "wiki")], "scope string, from_page string, to_page string, relation string")


def ids(df):
    return [r.page_id for r in df.collect()]


def test_strict_hits_come_first_and_partial_ones_fill_up(pages):
    assert ids(search.search(pages, "s", "copper ledger", 5, 40))[0] == "both"
    assert set(ids(search.search(pages, "s", "copper ledger", 5, 40))[1:]) == {"copper-only", "ledger-only"}
    assert ids(search.search(pages, "s", "copper ledger", 1, 40)) == ["both"]


def test_title_outweighs_body_ties_go_by_path_scopes_are_apart(pages):
    assert ids(search.search(pages, "s", "quartz resonance", 5)) == ["in-title", "in-body"]
    assert ids(search.search(pages, "s", "twinword", 5)) == ["tie-1", "tie-2"]
    assert ids(search.search(pages, "other", "copper", 5)) == ["foreign"]
    assert ids(search.search(pages, "s", "КАК ХРАНИЛИЩЕ, Баджер?", 5)) == ["kyrillisch"]
    with pytest.raises(InvalidQuery):
        search.search(pages, "s", "what is why")
    with pytest.raises(InvalidScope):
        search.search(pages, "  ", "copper")


def test_scan_and_index_agree(pages):
    terms = ["copper", "ledger", "the", "absent"]
    scan = {(r.scope, r.page_id): (r.matched, r.score) for r in search.matches(pages, terms).collect()}
    index = {(r.scope, r.page_id): (r.matched, r.score) for r in search.indexed_matches(search.postings(pages), search.doc_lengths(pages), terms).collect()}
    assert scan == index and len(scan) == 4
    assert search.indexed_matches(search.postings(pages), search.doc_lengths(pages), ["absent"]).count() == 0


def test_postings_are_counted_without_a_shuffle_and_rows_of_one_page_are_summed(spark, pages, monkeypatch):
    assert "Exchange" not in search.postings(pages)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "COUNTED_ROWS", 2)
    rows = [("s", "p", "Oak ash", "oak oak"), ("s", "q", "", None), ("s", "p", "fir", "oak"), ("t", "p", None, "Ash ash fir"), ("s", None, "elm", ""), ("s", None, "elm", "elm"), ("s", "r", "ash", "")]
    got = search.postings(spark.createDataFrame(rows, "scope string, page_id string, title string, body string")).collect()
    want = [("s", "p", "oak", 1, 3), ("s", "p", "ash", 1, 0), ("s", "p", "fir", 1, 0), ("t", "p", "ash", 0, 2), ("t", "p", "fir", 0, 1), ("s", None, "elm", 2, 1), ("s", "r", "ash", 1, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bm25_against_the_formula(pages):
    import math

    rows = pages.collect()
    toks = {r.page_id: (r.title.lower().split(), r.body.lower().split()) for r in rows}
    n, mean = len(rows), sum(len(t) + len(b) for t, b in toks.values()) / len(rows)
    df = sum("copper" in t or "copper" in b for t, b in toks.values())
    for r in search.matches(pages, ["copper"]).collect():
        t, b = toks[r.page_id]
        tf, dl = 8 * t.count("copper") + b.count("copper"), len(t) + len(b)
        assert r.score == pytest.approx(max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), abs=1e-6)


def test_neighbours_and_recent(pages, links, spark):
    seeds = spark.createDataFrame([("s", "both", 0), ("s", "copper-only", 1)], "scope string, page_id string, ordinal int")
    near = graph.neighbours(seeds, links, pages).orderBy("rank", "path")
    assert [(r.page_id, r.rank) for r in near.collect()] == [("copper-only", 0), ("tie-1", 0), ("both", 1), ("tie-2", 1)]
    assert ids(graph.recent(pages, "s", ["kyrillisch"], 2)) == ["tie-2", "tie-1"]
    assert graph.broken(links, pages).count() == 1
    assert [(r.from_page, r.to_page) for r in graph.page_links(links, "s", "tie-2").collect()] == [("copper-only", "tie-2")]


def test_context(pages, links):
    assert graph.select_context(pages, links, "s", ["copper", "ledger"], ReadLimits(pages=1)) == ["both"]
    got = graph.select_context(pages, links, "s", ["copper", "ledger"], ReadLimits(pages=6))
    assert got[0] == "both" and "index" in got and "tie-1" in got and len(got) == 6 and "foreign" not in got and "gone" not in got
    assert graph.select_context(pages, links, "s", ["absent"], ReadLimits(pages=3)) == ["index", "kyrillisch", "tie-2"]


@pytest.mark.parametrize(
    "limit,candidates,near,latest,want",
    [
        (0, ["a"], [], [], []),
        (1, ["a", "b"], ["n"], ["r"], ["a"]),
        (1, [], ["n"], ["r"], ["index"]),
        (5, ["a", "b", "c", "d"], ["n", "o"], ["r"], ["a", "b", "c", "n", "index"]),
        (6, ["a"], ["a", "n"], ["r", "s", "n"], ["a", "n", "index", "r", "s"]),
        (5, ["a", "b", "c", "d"], ["d"], [], ["a", "b", "c", "d", "index"]),
        (4, ["", "a", "a"], ["", "b"], ["c"], ["a", "b", "index", "c"]),
        (4, ["a", "b"], ["n", "o"], ["o", "n"], ["a", "b", "n", "index"]),
        (6, ["a"], ["n", "o", "p", "q", "r"], ["q"], ["a", "n", "o", "p", "q", "index"]),
    ],
)
def test_merge(spark, limit, candidates, near, latest, want):
    table = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "page_id string, i int")
    got = graph.merged(limit, table(candidates), table(near), table(latest)).orderBy("place").collect()
    assert [r.page_id for r in got] == want and [r.place for r in got] == list(range(len(want)))


def test_quota():
    assert [graph.candidate_quota(n) for n in (0, 1, 2, 3, 5, 20)] == [0, 1, 1, 2, 3, 13]


def test_evidence(pages, links):
    found = evidence.query(pages, links, "s", "copper ledger", ReadLimits(pages=3, characters=30))
    cites = [(r.kind, r.reference, r.page_id) for r in found.citations.collect()]
    assert cites == sorted(cites) and ("raw", "a:1@1", "both") in cites and ("wiki", "wiki/both.md", "both") in cites
    assert all(len(r.snippet) <= 30 and r.untrusted for r in found.hits.collect())
    assert len(found.links.collect()) == 3
    filed = evidence.filed(found.hits, "q").first()
    assert filed.source_id == "result-" + filed.digest[:16]


def test_read_pages(pages):
    assert ids(evidence.read_pages(pages, "s", ["tie-2", "wiki/both.md"])) == ["tie-2", "both"]
    with pytest.raises(KeyError):
        evidence.read_pages(pages, "s", ["foreign"])
    with pytest.raises(LimitExceeded):
        evidence.read_pages(pages, "s", ["both"], ReadLimits(characters=3))


def test_the_plan_of_a_search_is_one_projection_and_a_top_k(pages):
    plan = search.search(pages, "s", "copper ledger", 5, 40)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Join" not in plan


def test_the_retrieval_gate_asks_for_every_document(spark, small):
    from loamstack.plans import catalog

    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert catalog.queries()["retrieval_gate"](spark, small).first()["queries"] == n > 20
    assert "% 20" not in catalog.oracle_sql()["retrieval_gate"] and "% 20" in catalog.oracle_sql()["search_batch"]
