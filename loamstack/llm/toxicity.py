"""Operator 6: toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled rows. Their terms are words and word
prefixes of 4 to 6 characters. All terms whose dependence on the label is shown by a
chi-square test are in the index, however many they are; the others, mostly words that
occur in a few texts only, carry no weight, since with all of them the nearest
texts are those of like subject and not of like tone. Vectors are TF-IDF with
(1 + ln tf) * ln(1 + n / df) and unit length. The inverted index divides the examples into blocks and keeps
for every term and block the largest weight in it. A text's bound for a block is
the sum of its weights times these maxima; blocks are scored exactly in order of
their bounds until no bound passes the k-th best cosine, so the k nearest are exact.

Neighbours vote by their cosine. A logistic curve, fitted on the examples
themselves with each one left out, turns the vote into a probability at the
labels' own rate; the neighbours are the evidence.

Defined cases: null or empty text, and text without a known term, has no
neighbour and gets the rate of such examples; without labels every score is 0; very
long texts count whole; repeated rows get the same result, and repeated examples count
as often as they are there; neighbours of equal cosine go by their place, which follows
from their id; a null id counts as the empty text in the fold; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, fold, lean, text_or_empty, written
from loamstack.llm.sampling import sampled, thinned

#: Bounds of the labelled sample: examples of each label, bytes of an example. Neighbours, examples of a block.
EXAMPLES, EXAMPLE_BYTES, NEIGHBOURS, BLOCK = 3000, 1 << 16, 12, 32
#: Least chi-square of a term, and the fewest examples that hold it.
CHI2, LEAST_DF = 25.0, 3
_words = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class _Terms(dict):
    """Word to the numbers of its known terms; bounded."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str):
        found = tuple(n for t in terms_of(word) if (n := self.number.get(t)) is not None)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class Nearest:
    """Block-max index over labelled TF-IDF vectors."""

    def __init__(self, number: dict[str, int], examples: list[tuple[object, int, dict[int, int]]], rate: float, k: int = NEIGHBOURS, block: int = BLOCK):
        import numpy as np

        self.number, self.k, self.block = number, k, block
        n = len(examples)
        df = Counter(t for _, _, tf in examples for t in tf)
        self.idf = np.zeros(len(number))
        for t, c in df.items():
            self.idf[t] = np.log(1 + n / c)
        vectors = [(i, y, *self.weigh(tf)) for i, y, tf in examples]
        # like examples side by side make tight bounds
        vectors = [v for v in vectors if len(v[2])]
        vectors.sort(key=lambda v: (int(v[2][v[3].argmax()]), v[1]))
        self.ids, self.labels = [v[0] for v in vectors], np.array([v[1] for v in vectors], "float64")
        blocks = -(-len(vectors) // block)
        self.bounds = np.zeros((len(number), blocks), "float32")
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(blocks)]
        for j, (_, _, at, w) in enumerate(vectors):
            for t, x in zip(at.tolist(), w.tolist()):
                self.postings[j // block].setdefault(t, []).append((j % block, x))
                self.bounds[t, j // block] = max(self.bounds[t, j // block], np.float32(x) * np.float32(1.000001))
        self.curve, self.alone = (0.0, 0.0), rate
        self._calibrate(examples, vectors, rate)

    def weigh(self, tf: dict[int, int]):
        import numpy as np

        at = np.array(sorted(tf), "int64")
        w = (1 + np.log(np.array([tf[t] for t in sorted(tf)], "float64"))) * self.idf[at] if len(at) else np.zeros(0)
        keep = w > 0
        at, w = at[keep], w[keep]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, tf: dict[int, int]) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest examples with a positive cosine; ties by the example's place."""
        return self._search(*self.weigh(tf))

    def _search(self, at, w, without: int = -1) -> list[tuple[float, int]]:
        import numpy as np

        if not len(at) or not self.postings:
            return []
        bound, terms = w @ self.bounds[at], [*zip(at.tolist(), w.tolist())]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) >= self.k and bound[b] < best[-1][0]:
                break
            scores: dict[int, float] = {}
            own = self.postings[b]
            for t, x in terms:
                for j, y in own.get(t, ()):
                    scores[j] = scores.get(j, 0.0) + x * y
            base = b * self.block
            best += [(s, base + j) for j, s in scores.items() if base + j != without]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[self.k :]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        return sum(s * self.labels[j] for s, j in near) / sum(s for s, _ in near)

    def _calibrate(self, examples, vectors, rate: float) -> None:
        import numpy as np

        votes, ys = [], []
        for j, (_, y, at, w) in enumerate(vectors):
            near = self._search(at, w, j)
            if near:
                votes.append(self.vote(near))
                ys.append(y)
        pos = sum(y for _, y, _ in examples)
        neg = len(examples) - pos
        weight = {1: rate / max(pos, 1), 0: (1 - rate) / max(neg, 1)}
        lone = [y for _, y, tf in examples if not len(self.weigh(tf)[0])]
        mass = sum(weight[y] for y in lone)
        self.alone = sum(y * weight[y] for y in lone) / mass if mass else rate
        if not votes:
            return
        x, y = np.array(votes), np.array(ys, "float64")
        wt = np.array([weight[v] for v in ys])
        wt *= len(wt) / wt.sum()
        a, b = 4.0, -2.0
        for _ in range(200):  # Newton steps on a lightly regularized logistic loss
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * wt * x).sum() + 0.05 * a, ((p - y) * wt).sum() + 0.05 * b])
            r = np.maximum(p * (1 - p), 1e-9) * wt
            h = np.array([[(r * x * x).sum() + 0.05, (r * x).sum()], [(r * x).sum(), r.sum() + 0.05]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.curve = (float(a), float(b))

    def score(self, near: list[tuple[float, int]]) -> float:
        import math

        if not near:
            return float(self.alone)
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a * self.vote(near) + b))))


def examples_of(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = EXAMPLES) -> tuple[DataFrame, float]:
    """(id, label, text) of about ``rows`` labelled rows of each label (8 * ``rows`` at most, however often an id repeats), outside the held-out fold, and the rate of label 1 among all such labels."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where((fold(5) != 0) & F.col("label").isin(0, 1)).distinct()
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    chosen = sampled(known, ["doc_id"], rows, "label")
    source = docs.select("doc_id", text_or_empty().alias("text"))
    # the chosen labels are a bounded sample: about 2 * rows rows of two numbers
    joined = source.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= EXAMPLE_BYTES)
    return thinned(written(joined.select(F.col("doc_id").alias("id"), "label", "text"), "examples"), 8 * rows), (ones or 0) / n if n else 0.0


def fit(examples: DataFrame, rate: float, chi2: float = CHI2) -> Nearest | None:
    """The index over the examples; only bounded tables reach the driver."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            held = (Counter(), Counter())
            for y, raw in zip(batch.column("label").to_pylist(), binary_rows(batch, "text")):
                held[y].update({t for w in set(_words(raw.decode("utf-8", "replace").lower())) for t in terms_of(w) if len(t) <= 64})
            every = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([held[0][t] for t in every], pa.int64()), pa.array([held[1][t] for t in every], pa.int64())], names=["term", "n0", "n1"])

    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = sizes.get(0, 0), sizes.get(1, 0)
    if not a + b:
        return None
    found = examples.select("label", "text").mapInArrow(counted, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    total, df = float(a + b), F.col("n0").cast("double") + F.col("n1").cast("double")
    test = total * F.pow(n1 * (a - n0) - n0 * (b - n1), F.lit(2.0)) / F.greatest(F.lit(1e-9), df * (total - df) * F.lit(float(max(a, 1)) * max(b, 1)))
    best = found.where(f"n0 + n1 >= {LEAST_DF}").withColumn("test", test).where(F.col("test") >= chi2)
    # terms of a bounded sample, each in LEAST_DF examples or more
    number = {t: i for i, t in enumerate(sorted(r["term"] for r in best.select("term").collect()))}
    shared = examples.sparkSession.sparkContext.broadcast(number)

    def vectors(batches):
        import pyarrow as pa

        look = _Terms(shared.value)
        for batch in batches:
            tfs = [Counter(t for w in _words(raw.decode("utf-8", "replace").lower()) for t in look[w]) for raw in binary_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([list(tf) for tf in tfs], pa.list_(pa.int32())), pa.array([list(tf.values()) for tf in tfs], pa.list_(pa.int32()))], names=["id", "label", "terms", "tfs"])

    kind = examples.schema["id"].dataType.simpleString()
    rows = examples.mapInArrow(vectors, f"id {kind}, label int, terms array<int>, tfs array<int>").collect()
    ordered = sorted(((r["id"], r["label"], dict(zip(r["terms"], r["tfs"]))) for r in rows), key=lambda x: (str(x[0]), x[1], sorted(x[2].items())))
    return Nearest(number, ordered, rate)


def score(docs: DataFrame, model: Nearest | None, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """id_col, held_out, score, predicted, evidence (the nearest examples: id as text, cosine, label)."""
    source = docs.select(F.col(id_col).alias("id"), (fold(5, id_col) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        index = shared.value
        look = _Terms(index.number) if index else None
        kind = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for batch in batches:
            scores, proof = [], []
            for raw in binary_rows(batch, "text"):
                near = []
                if index:
                    found = [ts for w in _words(raw.decode("utf-8", "replace").lower()) if (ts := look[w])]
                    near = index.nearest(Counter(t for ts in found for t in ts)) if found else []
                scores.append(index.score(near) if index else 0.0)
                proof.append([{"id": str(index.ids[j]), "cosine": s, "label": int(index.labels[j])} for s, j in near[:evidence]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(proof, kind)], names=["id", "held_out", "score", "predicted", "evidence"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int, evidence array<struct<id:string,cosine:double,label:int>>"
    return lean(source).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's form: examples outside the held-out fold, a score for every row."""
    return score(docs, fit(*examples_of(docs, labels)))
