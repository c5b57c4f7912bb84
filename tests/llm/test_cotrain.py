import zlib

import numpy as np

from loamstack.llm import cotrain as C


def test_shapes_and_features():
    assert C.shape(b"THE!!") == b"X!" and C.shape(b"This") == b"Xx" and C.shape(b"a12.") == b"x9."
    slots = C._Slots()
    for raw in (b"", b"one", b"\n\n", b"x" * 100000):
        assert np.isfinite(C.text_features(raw, slots)).all() and np.isfinite(C.meta_features(raw, None, None, None)).all()


def teacher(text, meta):
    """The exchange over rows in memory, round by round."""
    taught, order = [set(), set()], []

    def teach(views):
        out = [[], []]
        found = []
        for k, x in enumerate((text, meta)):
            p = np.round(views.view(k, x), 9)
            for label in (0, 1):
                sure = p if label else 1 - p
                some = [i for i in range(len(x)) if sure[i] >= C.CONFIDENT and i not in taught[1 - k]]
                found += [(k, label, i) for i in sorted(some, key=lambda i: (-sure[i], i))[: C.ADDED]]
        for k, label, i in found:
            taught[1 - k].add(i)
            out[1 - k].append((text[i], meta[i], float(label)))
            order.append((k, label, i))
        return out

    return teach, order


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2400)
    text = (y[:, None] * 2.0 + rng.normal(size=(2400, 3))).astype("float32")
    meta = (y[:, None] * 3.0 + rng.normal(size=(2400, 2))).astype("float32")
    views = C.Views([(text[i], meta[i], int(y[i])) for i in range(200)], teacher(text[200:1200], meta[200:1200])[0], 0.5)
    assert views.ready and min(views.taught) > 20
    a, b, both = views.scores(text[1200:], meta[1200:])
    right = [((s >= 0.5) == y[1200:]).mean() for s in (a, b, both)]
    assert right[2] >= max(right[:2]) - 0.005 and right[2] > 0.97
    # calibrated: the mean probability is the share of ones
    assert abs(both.mean() - y[1200:].mean()) < 0.05


def test_exchange_over_the_whole_table_against_memory(spark, monkeypatch):
    monkeypatch.setattr(C, "ADDED", 15)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.limit(600).unionByName(docs.limit(40))  # repeated rows too
    table, (a, b, key) = C.featured(docs, ["doc_id"])
    model = C.fit(table, (a, b, key), labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(r.doc_id, np.frombuffer(r[a], "float32"), np.frombuffer(r[b], "float32"), r[key]) for r in table.collect()]
    own = sorted(((str(i), truth[i], x.tobytes(), x, y) for i, x, y, _ in rows if i in truth and not held(i)), key=lambda r: r[:3])
    pool = {k: (x, y) for i, x, y, k in rows if i not in truth and not held(i)}
    keys = sorted(pool)
    teach, order = teacher(*(np.stack([pool[k][v] for k in keys]) for v in (0, 1)))
    known = [t for i, t in truth.items() if not held(i)]
    want = C.Views([(x, y, t) for _, t, _, x, y in own], teach, sum(known) / len(known))
    assert model.taught == want.taught and sum(want.taught) > 60
    x, y = (np.stack([r[k] for r in rows]) for k in (1, 2))
    assert all(np.allclose(p, q, atol=1e-6) for p, q in zip(model.scores(x, y), want.scores(x, y)))


def test_held_out_and_edges(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    scored = C.quality(docs, labels).collect()
    rows = [r for r in scored if r.held_out and r.doc_id in truth]
    assert sum(r.accepted == bool(truth[r.doc_id]) for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (None, "", "", "s", 0, 1), (2, "THE!! " * 50000, "en", "s", 3, 1), (2, "THE!! " * 50000, "en", "s", 3, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    odd = odd.selectExpr("*", "'x' AS view_a", "1 AS q_lang", "2 AS label", "3 AS view_key", "'t' AS q_text")
    wide = docs.selectExpr("*", "1 AS score", "'x' AS view_a", "1 AS q_lang", "2 AS label", "3 AS view_key", "'t' AS q_text").unionByName(odd)
    kept = C.accepted(wide, labels)
    assert kept.columns == wide.columns
    assert kept.where("score = 1 AND doc_id = 2 AND text LIKE 'THE!! THE!!%'").count() == 0
    assert abs(kept.count() - sum(r.accepted for r in scored)) <= 12
    assert C.quality(docs.limit(0), labels).count() == 0
    assert C.quality(odd, labels.limit(0)).where("accepted").count() == 4
    assert C.accepted(odd, labels.limit(0)).count() == 4
    assert C.quality(odd.select("doc_id", "text"), labels).count() == 4
