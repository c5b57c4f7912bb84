import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamstack.functions import lexical as L
from loamstack.model import InvalidQuery, page_limit


def plain_tokens(text):
    import regex

    return regex.findall(L.TOKEN, text.lower())


CASES = ["Where is the lease?", "café naïve 42nd", "ÜBER straße", "don't re-open", "", "x" * 300, "étude ́mark", "日本語 テスト", "a_b-c"]


def test_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, t string").select("i", L.tokens(F.col("t")).alias("k")).collect()
    assert {r.i: list(r.k) for r in rows} == {i: plain_tokens(t) for i, t in enumerate(CASES)}


def test_query_terms():
    assert L.query_terms("How does the Lease, the LEASE renew?") == ["the", "lease", "renew"]
    for bad in ("", "what is why", " ".join(f"t{i}" for i in range(33)), "y" * 257):
        with pytest.raises(InvalidQuery):
            L.query_terms(bad)
    assert [page_limit(n) for n in (-1, 0, 7, 500)] == [20, 20, 7, 100]


def test_summary_stops_at_the_bounds(spark):
    texts = [" ".join(f"t{i}" for i in range(50)), "y" * 300 + " short", "z" * 200 + " " + "w" * 100 + " tail", "what is"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.summary_terms(F.col("t")).alias("k")).collect()
    got = {r.i: list(r.k) for r in rows}
    assert got[0] == [f"t{i}" for i in range(32)] and got[1] == ["short"] and got[2] == ["z" * 200] and got[3] == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13), st.integers(1, 40)), min_size=5, max_size=25))
def test_excerpt_holds_the_match_whatever_surrounds_it(spark, cases):
    rows = spark.createDataFrame([(i, "a " * a + "match" + " b" * b) for i, (a, b, _) in enumerate(cases)], "i int, body string")
    for limit in sorted({c[2] for c in cases}):
        for r in rows.select("i", "body", L.excerpt(F.lit(""), F.col("body"), ["match"], limit).alias("x")).collect():
            assert len(r.x) <= limit
            assert ("match" in r.x) if limit >= 5 else r.x in r.body
            if len(r.body.strip()) > limit > 7:
                assert "…" in r.x


def test_excerpt_cases(spark):
    def one(title, body, terms, limit):
        return spark.createDataFrame([(title, body)], "t string, b string").select(L.excerpt(F.col("t"), F.col("b"), terms, limit)).first()[0]

    assert one("T", "body", ["x"], 0) == "body"
    assert one("T", "body", ["body"], 50) == "T\nbody"
    assert one("", "no hit in here", ["zz"], 6) == "no hi…"
    assert one("", "no hit", ["zz"], 1) == "…"
    assert one("", "aaaa match bbbb", ["match"], 5) == "match"
    assert one("", "aaaa match bbbb", ["match"], 9) == "… match …"
    assert one("", "rematch amatch", ["match"], 8) == "rematch…"
