import math
import random
import re
from collections import Counter, defaultdict

import pytest

from loamstack.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string"
BINS = {"lower": "[a-z]", "space": r"[\x20\x09-\x0D]", "letters": None, "upper": "[A-Z]", "digits": "[0-9]", "stops": r"[.,;:!?'\"()\-]", "symbols": "[#*$%&|<>]"}


def class_of(c):
    if ord(c) > 127:
        return "letters" if c.isalpha() else "other"
    return next((k for k, x in BINS.items() if x and re.match(x, c)), "other")


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit), failed


def divergence(p, q):
    return sum(x / 2 * math.log2(x / ((x + y) / 2)) for a, b in ((p, q), (q, p)) for k, x in a.items() if x > 0 for y in [b.get(k, 0)])


def chance(q, n):
    return sum(min(x / 2, 1 / (8 * n * math.log(2))) for x in q.values())


def brute(rows, guard_language=D.GUARD_LANGUAGE):
    rows = [(i, t or "", l or "") for i, t, l in rows]
    words, chars = defaultdict(Counter), defaultdict(Counter)
    for _, t, l in rows:
        words[l].update(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
        chars[l].update(map(class_of, t))
    out = []
    for i, t, l in rows:
        n, *rest, failed = base(t)
        total = words[l].total()
        common = {w for w, k in words[l].items() if k * D.COMMON >= total}
        fold = lambda c: Counter({w: c[w] for w in common if c[w]}) + Counter({None: sum(k for w, k in c.items() if w not in common)})
        share = lambda c: {k: x / c.total() for k, x in c.items()}
        ok, wd, cd = True, None, None
        if total >= guard_language and n >= D.GUARD_WORDS:
            q = share(fold(words[l]))
            wd = divergence(share(fold(Counter(re.findall(r"[^\x20\x09-\x0D]+", t.lower())))), q)
            ok &= wd <= chance(q, n) + D.WORD_MARGIN
        if total >= guard_language and len(t) >= D.GUARD_CHARS:
            q = share(chars[l])
            cd = divergence(share(Counter(map(class_of, t))), q)
            ok &= cd <= chance(q, len(t)) + D.CLASS_MARGIN
        far = lambda x: None if x is None else round(math.sqrt(max(x, 0)), 6)
        out.append((i, n, *rest, failed, ok and not failed, far(cd), far(wd)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(n, seed=3):
    r = random.Random(seed)
    usual = ["the", "of", "and", "a", "to", "été", "Straße"]
    rows = []
    for i in range(n):
        body = " ".join(r.choice(usual) if r.random() < 0.5 else "".join(r.choices("abcdefg", k=6)) for _ in range(r.randrange(0, 160)))
        kind = i % 8
        if kind == 1:
            body = body.replace(" ", "%%% ")
        if kind == 2:
            body = body.upper() + "!!"
        if kind == 3:
            body = "\n".join([body[:90]] * 3 + ["", " \t", " \t", body])
        rows.append((i, body, ["en", "de", None, ""][i % 4]))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "GUARD_LANGUAGE", 2000)
    rows = corpus(160) + [(None, None, "en"), (3, "", None), (3, "", None), (7, "x", "fr"), (900, "a b c d e " * 40, "en"), (901, "w " * 20_000, "de"), (902, "\x0b\x0c\r\n", "en")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS ws", "2 AS body", "'x' AS language", "3 AS rest_0", "4 AS n_words", "5 AS row", "6 AS `a.b`")
    want = brute(rows, 2000)
    assert got(D.quality_rules(docs)) == want
    assert {r[7] for r in want} == {True, False} and any(not r[6] and not r[7] for r in want)


def test_more_languages_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "GUARD_LANGUAGE", 200)
    monkeypatch.setattr(D, "BROADCAST_LANGUAGES", 2)
    rows = [(i, t, f"l{i % 5}") for i, t, _ in corpus(100, 5)]
    assert got(D.quality_rules(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 200)


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a", "a a a a a", "a b c d e f a b c d e x b c d e f", "x " + "p q r s t " * 9])
def test_windows_that_overlap(spark, text):
    row = D.quality_rules(spark.createDataFrame([(1, text, "en")], SCHEMA)).first()
    assert tuple(row[1:7]) == base(text)


def test_empty_table_and_no_python(spark):
    out = D.quality_rules(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
