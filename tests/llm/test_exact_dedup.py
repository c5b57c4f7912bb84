import hashlib
from collections import defaultdict

import pytest

from loamstack.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, n_bytes int, fp string"
ROWS = [(1, "a", 0, ""), (2, "a", 0, ""), (3, "b", 1, "x"), (4, None, 2, None), (5, "", 3, ""), (6, "xyz" * 5000, 0, ""), (7, "xyz" * 5000, 0, ""), (8, "xyz" * 4999 + "xyy", 0, ""), (9, "a", 0, ""), (9, "a", 0, ""), (None, "n", 0, ""), (None, "b", 0, ""), (10, "é", 0, ""), (11, "é", 0, "")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, seen = hashlib.sha256(t.encode()).hexdigest(), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, sha))
            seen |= i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("primes", [X.PRIMES, (3, 5)])
def test_against_brute_force_with_strong_and_colliding_fingerprints(spark, primes):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = X.exact_duplicates(docs, primes=primes, chunk_bytes=1024).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in ROWS])


def test_large_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_SALT", 7)
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(300)]
    got = X.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(brute(rows))


def test_empty_table(spark):
    assert X.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_combine_in_any_grouping(spark):
    raw = bytes(range(256)) * 41
    for size in (64, 1000, 65536):
        poly = X.Polynomial(chunk_bytes=size)
        chunks = [(1, k, bytearray(raw[i : i + size])) for k, i in enumerate(range(0, len(raw), size))]
        got = X.fingerprint_chunks(spark.createDataFrame(chunks, "doc_id long, chunk_no int, data binary"), chunk_bytes=size).collect()
        assert got[0].fp == ":".join(map(str, poly.text(raw))) == ":".join(map(str, X.Polynomial().text(raw)))
        assert got[0].n_bytes == len(raw)


def test_huge_texts_by_chunks_and_clashing_columns(spark):
    rows = [(i, ("ab" * 3000)[: 5990 + i % 3] + ("z" if i == 7 else ""), i, 1, "w") for i in range(12)] + [(3, ("ab" * 3000)[:5990], 3, 1, "w"), (50, None, 0, 1, "w"), (51, "", 0, 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, exact_sha int, exact_id int, wanted string")
    got = X.exact_duplicates(docs, chunk_bytes=512, huge=1024).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows])


def test_rows_that_stay(spark):
    rows = [(1, "a", "x"), (2, "a", "b"), (2, "a", "a"), (2, "a", "a"), (None, "n", "2"), (None, "n", "1"), (3, None, "x"), (4, "", None), (4, None, "y"), (5, "own", None), (6, "é" * 70000, "q"), (7, "é" * 70000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, exact_maybe string").selectExpr("*", "1 AS i", "2 AS s", "3 AS rows", "'k' AS kept", "doc_id AS exact_n")
    got = X.exact_rows(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], len(r[1] or ""), r[2]) for r in got.collect()), key=str) == sorted([(2, 1, "a"), (None, 1, "1"), (4, 0, "y"), (5, 3, None), (7, 70000, "q")], key=str)
    assert X.exact_rows(docs.limit(0)).count() == 0
