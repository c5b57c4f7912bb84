import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from loamstack.llm import simhash as S


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values, radius):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("width,radius", [(1, 0), (1, 3), (4, 40)])
def test_bit_sliced_distances(width, radius):
    rng = random.Random(width * 100 + radius)
    base = [rng.getrandbits(64 * width) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64 * width) for _ in range(rng.randrange(radius * 2 + 3))) & ((1 << 64 * width) - 1) for b in base for _ in range(7)]
    rows = np.array([[v >> 64 * k & (1 << 64) - 1 for k in range(width)] for v in values], "uint64")
    found = S.near(rows, radius)
    want = np.array([[i != j and (a ^ b).bit_count() <= radius for j, b in enumerate(values)] for i, a in enumerate(values)])
    assert (want == (found if found is not None else False)).all()


@pytest.mark.parametrize("block", [4, 256])
def test_links_connect_the_same_components(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ (sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1) for b in base for _ in range(12)} | {0, 1, 7, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "node long")
    got = {r.node: r.root for r in S.components(S.links_within(nodes, 3)).collect()}
    want = roots(values, 3)
    groups = lambda f: sorted(sorted(g) for g in _groups(f))
    assert groups({v % (1 << 64): got.get(s, s) for v, s in zip(values, signed)}) == groups(want)


def _groups(of):
    out = {}
    for k, r in of.items():
        out.setdefault(r, []).append(k)
    return out.values()


def test_documents_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    long = [rng.choice(words) for _ in range(400)]
    rows = [(i, " ".join([*long[: 7 * i], f"edit{i}", *long[7 * i + 1 :]])) for i in range(12)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "One two"), (104, "one TWO"), (105, "É x y z"), (None, "one two"), (103, "repeated id"), (107, "a b c")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect())
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = roots(sorted({f for _, f in fps}), 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert got == Counter((i, f"{f:016x}", least[root[f]]) for i, f in fps)


def test_one_row_of_each_similar_group_stays(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(7)
    rows = []
    for g in range(6):
        long = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(g * 100 + i, " ".join([*long[: 7 * i], f"edit{i}", *long[7 * i + 1 :]])) for i in range(40 if g == 0 else 3)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(1000 + i, shared + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(40)]
    rows += [(5000, None), (5001, ""), (None, "alone")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, least int")
    got = S.distinct_rows(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, [*(g * 100 for g in range(6)), *(1000 + i for i in range(40)), 5000, None]))


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(3)
    words = lambda x: np.frombuffer(x, "<u8")
    far = 0
    for shared, a, b in [(4, 1, 0), (4, 1, 0), (8, 1, 1), (12, 3, 0), (80, 10, 10), (80, 20, 0), (800, 100, 100)] * 40:
        made = rng.integers(0, 1 << 63, shared + a + b).astype("uint64")
        x, y = np.unique(made[: shared + a]), np.unique(np.concatenate([made[:shared], made[shared + a :]]))
        rows = np.stack([words(S.sketch(x)), words(S.sketch(y))])
        assert S.near(rows, S.RADIUS) is not None
        far = max(far, sum(int(v).bit_count() for v in rows[0] ^ rows[1]))
    assert 40 < far <= S.RADIUS
    # a block without a pair that matters is abandoned, and pairs that do not matter are left out
    rows = np.stack([words(S.sketch(rng.integers(0, 1 << 63, 50).astype("uint64"))) for _ in range(70)])
    assert S.near(rows, S.RADIUS) is None and S.near(rows[:3], S.RADIUS, rows[3:]) is None
    assert S.near(rows[:2], S.RADIUS, rows[1:4]).tolist() == [[False] * 3, [True, False, False]]
    assert S.near(rows[:2], S.RADIUS, rows[1:4], np.zeros((2, 3), bool)) is None


def _left(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in S.distinct_rows(docs, **more).collect())


def _sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]


def _stays(texts, pair=lambda i, j: True):
    """What a comparison of every pair leaves."""
    sets = _sets(texts)
    least = [*range(len(texts))]
    for i in least[:]:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and pair(i, j) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return sorted(set(least))


def test_different_texts_of_one_repeated_line_both_stay(spark):
    line = " ".join(f"r{i}" for i in range(7))
    texts = [" ".join([*[line] * 200, *(f"{c}{i}" for i in range(150))]) for c in "abc"]
    assert len({S.majority(S.shingle_hashes(t.encode(), 5)) for t in texts}) == 1
    assert _left(spark, texts) == _stays(texts) == [0, 1, 2]


def test_repeated_lines_and_short_texts_against_brute_force(spark):
    rng = random.Random(11)
    line = " ".join(f"r{i}" for i in range(7))
    texts = []
    for c in "abcd":
        body = [f"{c}{i}" for i in range(150)]
        texts += [" ".join([*[line] * n, *body[: 150 - k]]) for n, k in ((3, 0), (20, 1), (200, 2))]
    for g in range(60):
        words = [f"s{g}x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 13))]
        texts += [" ".join(words), " ".join(words[:-1]), " ".join([*words, "more"]), " ".join(["other", *words[1:]])]
    assert _left(spark, texts) == _stays(texts)


def test_large_buckets_and_cut_sets_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join([*base[: 7 * i], f"edit{i}", *base[7 * i + 1 :]]) for i in range(40)]
    monkeypatch.setattr(S, "WIDE", 4)
    minimum = [S._keys(np.unique(S.shingle_hashes(t.encode(), 5)), 1, 1)[0] for t in texts]
    assert max(Counter(minimum).values()) > 16
    # rows of a bucket that is too large share this one minimum and no other
    assert _left(spark, texts, bands=1, width=1) == _stays(texts, lambda i, j: minimum[i] == minimum[j])
    monkeypatch.setattr(S, "SET_SIZE", 16)
    texts = []
    for g in range(30):  # on both sides of the threshold, by one shingle
        words = [f"g{g}x{i}" for i in range(300)]
        texts += [" ".join(words), " ".join([*words[:-32], *(f"u{g}x{i}" for i in range(32))]), " ".join([*(f"v{g}x{i}" for i in range(33)), *words[33:]])]
    assert len(_stays(texts)) == 60
    assert _left(spark, texts) == _stays(texts)


def test_rows_outside_the_largest_group_meet_all_others(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "WIDE", 3)
    shared = [f"w{i}" for i in range(200)]
    # one bucket of a large group, of pairs and of single rows
    texts = [" ".join([*shared, *(f"a{k}" for k in range(60)), f"b{i}"]) for i in range(30)]
    texts += [" ".join([*shared, *(f"p{i // 2}x{k}" for k in range(90)), f"c{i}"]) for i in range(24)]
    texts += [" ".join([*shared, *(f"s{i}x{k}" for k in range(90))]) for i in range(12)]
    key = [S._keys(np.unique(S.shingle_hashes(t.encode(), 5)), 1, 1)[0] for t in texts]
    assert max(Counter(key).values()) > 40
    assert _left(spark, texts, bands=1, width=1) == _stays(texts, lambda i, j: key[i] == key[j])


def test_clashing_columns_ties_and_long_texts(spark):
    long = " ".join(f"l{i}" for i in range(30000))
    rows = [(1, long, "b", 1), (1, long, "a", 1), (1, long, "a", 1), (2, long + " end", "c", 1), (3, "other " + long[: len(long) // 2], "c", 1), (4, None, "x", 1), (4, "", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_row string, root int").selectExpr("*", "'n' AS node", "1 AS near_size", "2 AS `at`", "3 AS row")
    got = [(r.doc_id, r.near_row) for r in S.distinct_rows(docs).collect()]
    assert S.distinct_rows(docs).columns == docs.columns
    assert [i for i, _ in sorted(got)] == [1, 3, 4]
    assert sorted(got) == sorted((r.doc_id, r.near_row) for r in S.distinct_rows(docs.orderBy(docs.near_row.desc())).collect())
    assert S.near_duplicates(docs).where("component_id = 1").count() >= 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.distinct_rows(docs).count() == 0
