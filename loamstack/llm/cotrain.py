"""Operator 9: quality by co-training of a text view and a page-metadata view.

Two logistic classifiers see different features of a document: its text
(character and word statistics, hashed word shapes, hashed words) and its
metadata (source, language, declared length, line layout). Features of every row
are made once and written. Both classifiers start from a bounded labelled sample.
In every round each scores all unlabelled rows outside the held-out fold with
calibrated probabilities, and its most confident different rows, found by a
distributed top k, become training rows of the other with the predicted label. At
last both views are calibrated on labelled rows that neither has trained on, and
a logistic combination of the calibrated views scores every document.

Labels are learned only outside the held-out fold. Defined cases: null text is
empty; null or missing metadata has its own feature; very long texts count whole;
repeated rows count once as pseudo-labels and are scored alike; ties of confidence
go by a hash of the features; an empty table gives an empty result; without labels of both
kinds every score is the labels' rate, or 1 without any label; other columns may have any name.
"""

from __future__ import annotations

import zlib
from operator import eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, fold, lean, text_or_empty, unused, written
from loamstack.llm.sampling import sampled, thinned

#: Labelled rows of each label (a bound of the sample), rounds, rows of each label that a view teaches in a round.
LABELLED, ROUNDS, ADDED = 2500, 4, 400
#: A row is confident from this calibrated probability on, or below its complement.
CONFIDENT = 0.98
SHAPES, WORDS, SOURCES, LANGS = 256, 512, 64, 16
_MARKS = b"!|&%$#*.,;:<>/@\"'()-_=+"


def shape(word: bytes) -> bytes:
    """The word with runs of letters of one case, digits and equal marks as one sign each."""
    out = bytearray()
    for b in word:
        c = 88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


class _Slots(dict):
    """Word to its two feature numbers; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = (zlib.crc32(shape(word[:256])) % SHAPES, SHAPES + zlib.crc32(word.lower()) % WORDS)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def text_features(raw: bytes, slots: _Slots):
    import numpy as np

    chars = np.bincount(np.frombuffer(raw, "uint8"), minlength=256).astype("float64")
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    counts = np.bincount([x for w in words for x in slots[w]], minlength=SHAPES + WORDS) / m
    repeats = sum(map(eq, words, words[1:])) / m
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = [
        chars[65:91].sum() / n, chars[97:123].sum() / n, chars[48:58].sum() / n, chars[128:].sum() / n, chars[32] / n, chars[10] / n,
        *(chars[b] / m for b in _MARKS),
        repeats, len(set(words)) / m, 1 - len(set(lines)) / max(1, len(lines)), len(raw) / m / 10, np.log1p(len(words)) / 10,
    ]
    return np.concatenate([np.minimum(stats, 3.0), np.sqrt(counts)]).astype("float32")


def meta_features(raw: bytes, source, lang, declared):
    import numpy as np

    lines = [len(x) for x in raw.split(b"\n")]
    out = np.zeros(12 + SOURCES + LANGS, "float32")
    out[0] = declared is None
    size = float(declared or 0)
    out[1], out[2] = np.log1p(max(0.0, size)) / 10, (np.log1p(max(0.0, size)) / 10) ** 2
    out[3], out[4] = np.log1p(len(lines)) / 5, np.log1p(np.mean(lines)) / 10
    out[5], out[6] = np.log1p(max(lines)) / 10, np.log1p(min(lines)) / 10
    out[7] = np.std(lines) / (1 + np.mean(lines))
    out[8] = sum(x < 30 for x in lines) / len(lines)
    out[9], out[10] = source is None, lang is None
    if source is not None:
        out[12 + zlib.crc32(str(source).encode()) % SOURCES] = 1
    if lang is not None:
        out[12 + SOURCES + zlib.crc32(str(lang).encode()) % LANGS] = 1
    return out


def _logit(p):
    import numpy as np

    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """Weighted ridge logistic regression by Newton steps on standardized features."""

    def __init__(self, ridge: float = 1.0):
        self.ridge, self.w = ridge, None

    def fit(self, x, y, weight, steps: int = 8):
        import numpy as np

        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1), x.dtype)]).astype("float64")
        w = np.zeros(z.shape[1])
        weight = weight * len(weight) / weight.sum()
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            r = np.maximum(p * (1 - p), 1e-5) * weight
            step = np.linalg.solve((z * r[:, None]).T @ z + np.diag(penalty), z.T @ ((p - y) * weight) + penalty * w)
            w -= step
            if abs(step).max() < 1e-4:
                break
        self.w = w
        return self

    def margin(self, x):
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class Views:
    """The two views, calibrated, and their combination."""

    def __init__(self, labelled, teach, rate: float):
        """``labelled``: (text features, metadata features, label) of each row; ``teach(views)``: for each view, the same of new rows that the other view is sure of."""
        import numpy as np

        self.rate, self.ready = rate, False
        y = np.array([r[2] for r in labelled], "float64")
        if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < 10:
            return
        views = [np.stack([r[k] for r in labelled]) for k in (0, 1)]
        # every fifth row of each label only calibrates
        held = np.zeros(len(y), bool)
        for v in (0, 1):
            held[np.flatnonzero(y == v)[::5]] = True
        prior = np.where(y == 1, rate / (y == 1).sum(), (1 - rate) / (y == 0).sum())
        even = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
        extra: list[list] = [[], []]
        for step in range(ROUNDS + 1):
            self.models, self.curves = [], []
            for k in (0, 1):
                x = np.stack([*views[k][~held], *(r[k] for r in extra[k])])
                t = np.concatenate([y[~held], [r[2] for r in extra[k]]])
                w = np.concatenate([even[~held], np.full(len(extra[k]), 0.5 / len(y))])
                model = Logistic().fit(x, t, w)
                self.models.append(model)
                self.curves.append(Logistic(0.1).fit(model.margin(views[k][held])[:, None], y[held], prior[held]))
            if step == ROUNDS:
                break
            found = teach(self)
            if not any(found):
                break
            for own, more in zip(extra, found):
                own.extend(more)
        self.taught = [len(e) for e in extra]
        both = np.stack([_logit(self.view(k, views[k][held])) for k in (0, 1)], 1)
        self.final = Logistic(0.1).fit(both, y[held], prior[held])
        self.ready = True

    def view(self, k: int, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.curves[k].margin(self.models[k].margin(x)[:, None]), -30, 30)))

    def scores(self, text, meta):
        """Calibrated text view, metadata view and their combination."""
        import numpy as np

        if not self.ready:
            return tuple(np.full(len(text), self.rate) for _ in range(3))
        a, b = self.view(0, text), self.view(1, meta)
        return a, b, 1 / (1 + np.exp(-np.clip(self.final.margin(np.stack([_logit(a), _logit(b)], 1)), -30, 30)))


def _inputs(docs: DataFrame, text_col: str) -> list:
    have = set(docs.columns)
    take = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    return [text_or_empty(text_col).alias("text"), take("source", "string").alias("source"), take("lang", "string").alias("lang"), take("n_chars", "double").alias("declared")]


def _features(batch, text: str, source: str, lang: str, declared: str, slots: _Slots):
    import numpy as np

    if not batch.num_rows:
        return np.zeros((0, len(text_features(b"", slots))), "float32"), np.zeros((0, 12 + SOURCES + LANGS), "float32")
    both = [(text_features(r[0], slots), meta_features(*r)) for r in zip(binary_rows(batch, text), *(batch.column(c).to_pylist() for c in (source, lang, declared)))]
    return np.stack([a for a, _ in both]), np.stack([b for _, b in both])


A, B, KEY = "view_a", "view_b", "view_key"


def featured(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[DataFrame, tuple[str, str, str]]:
    """``keep`` of every row with both feature vectors and their hash, as a written table, and the names of these three columns."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    kept = docs.select(*keep)
    text, source, lang, declared, a, b, key = unused(kept, "q_text", "q_source", "q_lang", "q_declared", A, B, KEY)
    wide = docs.select(*keep, *[c.alias(n) for c, n in zip(_inputs(docs, text_col), (text, source, lang, declared))])
    if text_col in keep:  # no second copy of the text; its nulls are empty
        wide, text = wide.drop(text), text_col

    def run(batches):
        import hashlib

        import pyarrow as pa

        slots = _Slots()
        for batch in batches:
            x, y = _features(batch, text, source, lang, declared, slots)
            rows = [(p.tobytes(), q.tobytes()) for p, q in zip(x, y)]
            keys = [int.from_bytes(hashlib.blake2b(p + q, digest_size=8).digest(), "little", signed=True) for p, q in rows]
            made = [pa.array([p for p, _ in rows], pa.binary()), pa.array([q for _, q in rows], pa.binary()), pa.array(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, a, b, key])

    kind = StructType([*kept.schema.fields, StructField(a, BinaryType()), StructField(b, BinaryType()), StructField(key, LongType())])
    return written(lean(wide).mapInArrow(run, kind), "features"), (a, b, key)


def _vectors(batch, names):
    import numpy as np

    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), "float32").reshape(batch.num_rows, -1) for c in names]


def surest(views: Views, a, b, keys, taught, added: int = ADDED) -> list[tuple[int, int, float, int]]:
    """(teacher, label, certainty, key) of the ``added`` surest different rows of each teacher and label that the other view has not been taught."""
    import numpy as np

    out = []
    keys = np.asarray(keys, "int64")
    for k, x in enumerate((a, b)):
        p = np.round(views.view(k, x), 9) if len(x) else np.zeros(0)
        for label, sure in ((1, p), (0, 1 - p)):
            at = np.flatnonzero(sure >= CONFIDENT)
            some = {int(i): float(s) for i, s in zip(keys[at], sure[at]) if int(i) not in taught[1 - k]}
            out += [(k, label, s, i) for i, s in sorted(some.items(), key=lambda r: (-r[1], r[0]))[:added]]
    return out


def fit(table: DataFrame, names: tuple[str, str, str], labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Views:
    """Fit on the table of ``featured``: about LABELLED rows of each label, and all other rows outside the held-out fold for the exchange.

    To the driver go the features of the labelled sample and of the rows that are taught, ADDED at most of each view and label in a round.
    """
    import numpy as np

    a, b, key = names
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where((fold(5) != 0) & F.col("label").isin(0, 1)).distinct()
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = (ones or 0) / n if n else 1.0
    # the chosen labels are a bounded sample: about 2 * LABELLED rows of two numbers
    chosen = written(sampled(known, ["doc_id"], LABELLED, "label"), "chosen")
    rows = table.select(F.col(id_col).alias("doc_id"), F.col(a).alias(A), F.col(b).alias(B), F.col(key).alias(KEY))
    own = thinned(written(rows.join(F.broadcast(chosen), "doc_id"), "labelled"), 8 * LABELLED).collect()
    own = sorted(own, key=lambda r: (str(r["doc_id"]), r["label"], bytes(r[A])))
    pool = rows.where(fold(5) != 0).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_anti").select(A, B, KEY)
    taught: list[set[int]] = [set(), set()]
    spark = table.sparkSession

    def teach(views: Views):
        shared = spark.sparkContext.broadcast((views, taught))

        def run(batches):
            import pyarrow as pa

            views, done = shared.value
            best: list = []
            for batch in batches:
                if batch.num_rows:
                    best += surest(views, *_vectors(batch, (A, B)), batch.column(KEY).to_pylist(), done)
                    best = _merged(best)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in best], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["teacher", "label", "sure", "key"])

        found = written(pool.mapInArrow(run, "teacher int, label int, sure double, key long").distinct(), "sure")
        top = None
        for k in (0, 1):
            for label in (0, 1):
                one = found.where(f"teacher = {k} AND label = {label}").orderBy(F.desc("sure"), "key").limit(ADDED)
                top = one if top is None else top.unionByName(one)
        top = top.collect()
        keys = spark.createDataFrame(sorted({(r["key"],) for r in top}), f"{KEY} long")
        vectors = {r[KEY]: (np.frombuffer(r[A], "float32"), np.frombuffer(r[B], "float32")) for r in pool.join(F.broadcast(keys), KEY).dropDuplicates([KEY]).collect()}
        out: list[list] = [[], []]
        for r in sorted(top, key=lambda r: (r["teacher"], r["label"], -r["sure"], r["key"])):
            taught[1 - r["teacher"]].add(r["key"])
            out[1 - r["teacher"]].append((*vectors[r["key"]], float(r["label"])))
        return out

    return Views([(np.frombuffer(r[A], "float32"), np.frombuffer(r[B], "float32"), r["label"]) for r in own], teach, rate)


def _merged(best: list, added: int = ADDED) -> list:
    """The ``added`` surest different rows of each teacher and label."""
    kept: dict = {}
    for r in sorted(set(best), key=lambda r: (r[0], r[1], -r[2], r[3])):
        own = kept.setdefault(r[:2], [])
        if len(own) < added:
            own.append(r)
    return [r for own in kept.values() for r in own]


def score(table: DataFrame, names: tuple[str, str, str], model: Views, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """id_col, held_out, score (probability of label 1), text_score, meta_score, accepted for each row of the table of ``featured``."""
    source = table.select(F.col(id_col).alias("id"), (fold(5, id_col) == 0).alias("held_out"), *(F.col(c) for c in names[:2]))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        views = shared.value
        for batch in batches:
            if batch.num_rows:
                a, b, both = views.scores(*_vectors(batch, names[:2]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), *(pa.array(x, pa.float64()) for x in (both, a, b)), pa.array(both >= threshold, pa.bool_())], names=["id", "held_out", "score", "text_score", "meta_score", "accepted"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, text_score double, meta_score double, accepted boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the combined views accept, with their columns as they are."""
    table, names = featured(docs, docs.columns, text_col)
    shared, columns = docs.sparkSession.sparkContext.broadcast(fit(table, names, labels, id_col)), docs.columns

    def run(batches):
        import pyarrow as pa

        views = shared.value
        for batch in batches:
            if batch.num_rows:
                yield batch.select(columns).filter(pa.array(views.scores(*_vectors(batch, names[:2]))[2] >= threshold, pa.bool_()))

    return lean(table).mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's form: fit outside the held-out fold, score every row."""
    table, names = featured(docs, ["doc_id"])
    return score(table, names, fit(table, names, labels))
