import math

import numpy as np
import pytest

from loamstack.llm import ppm_langid as L


def slow(counts, text, depth, lang):
    """PPM method C, byte by byte."""
    total = 0.0
    text = bytes(L.folded(np.frombuffer(text, "uint8")))
    for i in range(len(text)):
        for k in range(min(depth - 1, i), -1, -1):
            context, own = text[i - k : i], counts[k]
            n = sum(v[lang] for s, v in own.items() if s[:-1] == context)
            d = sum(v[lang] > 0 for s, v in own.items() if s[:-1] == context)
            known = k == 0 or any(v for s, v in counts[k - 1].items() if s == context)
            if not known or not n:
                continue
            if c := own.get(text[i - k : i + 1], [0, 0])[lang]:
                total += -math.log2(c / (n + d))
                break
            total += -math.log2(d / (n + d))
        else:
            total += 8
    return total


@pytest.mark.parametrize("dense", [0, 1 << 12, L.DENSE])
def test_code_lengths_are_exact(dense):
    texts = [b"abracadabra abba", b"barbara ann \xc3\x89t\xc3\xa9"]
    counts = [{} for _ in range(4)]
    for lang, t in enumerate(texts):
        t = bytes(L.folded(np.frombuffer(t, "uint8")))
        for k in range(1, 5):
            for i in range(len(t) - k + 1):
                counts[k - 1].setdefault(t[i : i + k], [0, 0])[lang] += 1
    trees = L.ContextTrees(["x", "y"], counts).tables(dense)
    probe = [b"abra", b"", b"zzz", b"ann barb ABBA", b"\xc3\xa9\xc3\x89", b"abracadabra abba barbara"]
    got = trees.code_lengths(np.frombuffer(b"".join(probe), "uint8"), np.cumsum([0, *map(len, probe[:-1])]))
    want = [[slow(counts, p, 4, lang) for lang in (0, 1)] for p in probe]
    assert np.allclose(got, want, atol=1e-3)
    assert np.allclose(L._whole(trees, probe[-1], 5), want[-1], atol=1e-3)


def test_held_out_accuracy_and_edges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in L.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) / len(held) > 0.9
    odd = spark.createDataFrame([(1, None, "en", 0.5), (2, "", "en", 0.5), (3, "123 !?", "en", 0.5), (4, "the " * 300000, None, 0.5), (None, "der die das", "de", 0.5), (4, "é", "fr", 0.5)], "doc_id long, text string, lang string, score double")
    got = [(r.doc_id, r.lang_pred) for r in L.identify(odd, L.fit(docs)).collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == (4, "en") and got[4] == (None, "de")
    assert L.languages(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}


def test_a_small_language_keeps_its_strings_beside_a_large_one(spark):
    big = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(26 * 20))
    docs = spark.createDataFrame([(i, big, "big") for i in range(20)] + [(99, "žluťoučký kůň", "small")], "doc_id long, text string, lang string")
    trees = L.fit(docs)
    # every string of the sample is there
    assert all(len(k) == len({t for x in (big, "žluťoučký kůň") for t in _strings(x.encode())[n]}) for n, k in enumerate(trees.keys))
    small = L.ContextTrees(["small"], [{s: [n] for s, n in own.items()} for own in _strings("žluťoučký kůň".encode())]).tables()
    data = np.frombuffer("žluťoučký kůň".encode(), "uint8")
    got = trees.tables().code_lengths(data, np.zeros(1, "int64"))[0][trees.languages.index("small")]
    assert trees.languages == ["big", "small"] and np.isclose(got, small.code_lengths(data, np.zeros(1, "int64"))[0][0], atol=1e-3)


def _strings(text):
    text = bytes(L.folded(np.frombuffer(text, "uint8")))
    counts = [{} for _ in range(L.MAX_ORDER + 1)]
    for k in range(1, L.MAX_ORDER + 2):
        for i in range(len(text) - k + 1):
            counts[k - 1][text[i : i + k]] = counts[k - 1].get(text[i : i + k], 0) + 1
    return counts
