import re

import pytest

from loamstack.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window):
    out = {}
    for i, t in docs:
        words, hit, found = W.findall(lower(t)), set(), set()
        for item, text in items:
            own = W.findall(lower(text))
            n = min(window, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for b in range(len(words) - n + 1):
                    if words[b : b + n] == own[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add("" if item is None else str(item))
        out[i] = (len(words), len(hit), sorted(found))
    return out


DOCS = [(1, "The Quick brown-fox jumps over; the lazy dog"), (2, None), (3, ""), (4, "É été À b c quick brown fox"), (5, "x " * 40 + "solo end"), (6, "quick brown fox jumps quick brown fox jumps"), (7, "nothing here"), (8, "aquick brown foxes"), (8, "quick, brown FOX jumps")]
ITEMS = [(10, "quick BROWN fox jumps over"), (9, "solo"), (11, None), (12, "  ,, "), (13, "x x x x x"), (None, "été à b"), (14, "quick brown fox jumps")]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 16])
def test_against_brute_force_in_one_and_many_slices(spark, slice_bytes):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in DOCS], "doc_id long, text string, n_hit int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.scan_documents(docs, items, window=4, slice_bytes=slice_bytes).collect()
    want = [(i, *brute([(i, t)], ITEMS, 4)[i]) for i, t in DOCS]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)
    text = dict(DOCS)
    for r in got:
        if r.doc_id != 8:
            assert r.n_hit == sum(len(W.findall(lower(text[r.doc_id])[s.start : s.end])) for s in r.spans)
    kept = D.clean_documents(docs, items, window=4, slice_bytes=slice_bytes)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, n, _ in want if not n)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert {r.n_hit for r in D.scan_documents(docs, none).collect()} == {0}
    assert D.contamination(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
