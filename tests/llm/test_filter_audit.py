import itertools
import random
import re
from collections import Counter

import pytest

from loamstack.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        x
        for x, bad in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
        }.items()
        if bad
    }


def brute(docs, labels):
    docs = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    rows = [(s, fails(t) | ({"E"} if i is not None and first[t] < i else set()), i in good, i in toxic) for i, t, s in docs]
    steps, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                kept = [r for r in left if x not in r[1]]
                steps[part, order, k + 1] = (len(kept), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, x] += len(gone)
                left = kept
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in steps.items())


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", "A " * 60, "word " * 60, "x # y", " ".join(map(str, range(80))), "\t\n\x0b", "é" * 30] + [" ".join(r.choice(["Aa", "b", "c$", "DD", f"w{k}"]) for k in range(r.randrange(90))) for _ in range(40)]
    docs = [(i, r.choice(texts), r.choice(["a", "b", "", None])) for i in range(300)]
    docs += [(5, "same", "a"), (5, "same", "a"), (9, "same", "b"), (None, "same", "a"), (None, None, None), (None, "A " * 60, "c"), (400, "w" * 100_000 + " x" * 50_000, "d")]
    labels = [(i, i % 2, i % 3) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1), (5, 1, 1)]
    wide = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS mask", "2 AS sha", "3 AS first", "4 AS part", "5 AS words", "6 AS `a.b`")
    got = A.filter_audit(wide, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == brute(docs, labels)


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.filter_audit(spark.createDataFrame([], DOCS), none).count() == 0
    got = A.filter_audit(spark.createDataFrame([(1, "x", "s")], DOCS), none)
    assert got.count() == 600 and got.where("good_lost + toxic_lost > 0").count() == 0


def test_the_recursion_is_bounded_by_its_letters(spark):
    assert A.walk(spark).count() == 325 * 32
    assert A.walk(spark, "xyz").where("mask = 7 AND removed").count() == 3
    with pytest.raises(ValueError):
        A.walk(spark, "ABCDEFG")
