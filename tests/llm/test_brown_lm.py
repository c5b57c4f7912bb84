import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loamstack.llm import brown_lm as B


def test_exchange_raises_the_likelihood_and_finds_two_alternating_classes(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(x for _ in range(40) for x in (f"a{rng.integers(8)}", f"b{rng.integers(8)}")) for _ in range(30)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    own = [B.END, *[f"{c}{i}".encode() for c in "ab" for i in range(8)]]
    pairs = B.count_pairs(docs, own).persist()
    weight = np.ones(len(own) + B.ENDINGS)
    values = []
    for rounds in range(4):
        classes, joint = B.cluster(pairs, weight, 3, rounds)
        values.append(B.objective(joint))
    assert values == sorted(values) and values[-1] > values[0]
    assert len(set(classes[1:9])) == 1 and len(set(classes[9:17])) == 1 and classes[1] != classes[9]


ROWS = [(i, t) for i, t in enumerate(["The cat sat", "the dog sat\tdown", "", None, "a cat\nand A dog and a bird", "unheard-of words here", "the the the", "x" * 300 + " cat"] * 3)] + [(None, "the cat"), (5, "the zebra")]


def test_base_counts_and_probabilities(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ROWS], "doc_id long, text string, score double")
    rows = docs.select("doc_id", (B.fold(7) == 2).alias("held_out"), B.text_or_empty().alias("text"))
    model, counts = B.fit(rows.where("NOT held_out"), units=6, k=3, rounds=2, lookup=4)
    got = B.score(rows, model, counts, carry=("held_out",)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    train = Counter(w for i, t in ROWS if not held(i) for w in B.tokens((t or "").encode()))
    n, v = sum(train.values()), len(train)
    units = B._Units(model.own)

    def logp(t):
        words = B.tokens((t or "").encode())
        classes = [int(model.classes[units[w]]) for w in [B.END, *words]]
        return sum(model.transition[a, b] for a, b in zip(classes, classes[1:])) + sum(model.emission(c, train[w]) for c, w in zip(classes[1:], words))

    want = sorted((str(i), held(i), len(ws := B.tokens((t or "").encode())), sum(w in train for w in ws), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 6), round(logp(t), 6)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    # after every class the seen words and one unseen word of each class sum to 1
    emitted = np.zeros(3)
    for w, c in train.items():
        emitted[model.classes[units[w]]] += 10 ** model.emission(int(model.classes[units[w]]), c)
    emitted += 10**model.unseen
    assert np.allclose(10**model.transition @ emitted, 1)


def test_better_than_the_base_on_held_out_text(spark):
    rows = B.held_out_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_words_to_the_12000th_are_units(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k, 11_999, 4)),) for k in range(4)], "text string")
    model, _ = B.fit(docs, rounds=0)
    assert set(model.own) == {B.END, *(f"w{i}".encode() for i in range(11_999))}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.held_out_scores(docs).count() == 0
    only = spark.createDataFrame([(2, None), (9, "a b")], "doc_id long, text string").withColumn("held_out", B.F.lit(True))
    got = B.score(only, *B.fit(only.where("NOT held_out"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
