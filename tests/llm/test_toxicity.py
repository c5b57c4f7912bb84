import math
import random

import pytest

from loamstack.llm import toxicity as T


def dense(index, tf):
    at, w = index.weigh(tf)
    return dict(zip(at.tolist(), w.tolist()))


@pytest.mark.parametrize("block", [1, 4, 32])
def test_nearest_are_exact(block):
    rng = random.Random(block)
    number = {f"t{i}": i for i in range(30)}
    draw = lambda: {rng.randrange(30): rng.randrange(1, 5) for _ in range(rng.randrange(8))}
    examples = [(i, rng.randrange(2), draw()) for i in range(90)]
    index = T.Nearest(number, examples, 0.5, k=5, block=block)
    by_id = {i: dense(index, tf) for i, _, tf in examples}
    for _ in range(60):
        q = dense(index, tf := draw())
        cosines = sorted((-sum(x * by_id[i].get(t, 0) for t, x in q.items()) for i in by_id), reverse=False)
        want = [-c for c in cosines if c < 0][:5]
        got = [s for s, _ in index.nearest(tf)]
        assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got, want))


def test_held_out_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(*T.examples_of(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in T.score(docs, model).collect() if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.93
    # every term that depends on the label is in the index, and the query's own columns do not meet those of the table
    few = T.fit(*T.examples_of(docs, labels), chi2=1.0)
    assert len(few.number) > len(model.number) > 20
    clash = docs.selectExpr("*", "1 AS held_out", "'x' AS evidence", "2 AS label", "3 AS id", "4 AS predicted")
    again = {r.doc_id: r.score for r in T.toxicity(clash, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "zzz " * 100000, 3), (2, "you idiot scum", 3)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.predicted, len(r.evidence)) for r in T.score(odd, model).collect()]
    assert got[:3] == [(1, 0, 0), (None, 0, 0), (2, 0, 0)] and got[3][2] > 0
    assert T.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in T.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    assert T.toxicity(odd, nulls).count() == 4
