"""Operator 1: language-model scoring by a Brown class-based bigram model.

Every token has one class, and the model is

    P(w | previous) = P(class(w) | class(previous)) * P(w | class(w)).

Counts come from all training text. Words become classes by exchange clustering
over *units*: each of the ``UNITS`` most frequent words is its own unit, every
other word belongs to the unit of its ending (crc32 of the last three bytes), so
that unseen words have a class too. A round computes, from the counts of all
adjacent unit pairs, each unit's successors and predecessors by class; units
then move one after the other, in order of frequency, to the class that raises
the likelihood most, with the class counts kept up to date. The pair table stays
distributed; the driver holds units by classes and the pairs among the ``HEAD`` first
units, which the parameters bound.

Class transitions are Witten-Bell smoothed with the class distribution. Within a
class c unseen words share the mass u(c) = (singletons(c) + 1/2) / (N(c) + 1) and a
seen word has N(w) / N(c) * (1 - u(c)), so the probabilities over all seen words
and one unseen word of each class sum to 1 after every class. A text starts
after an end token and ends with one.

Scoring reads each text once. The counts of the ``LOOKUP`` most frequent words
are broadcast (their number and length are bounded); other words are joined with
the full count table, summed within the document before they are shuffled.

Defined cases: null text has only its end token; a null id counts as the empty
text in the fold; without training text every word is unseen.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, fold, lean, text_or_empty, written

#: Words that are units of their own, units of endings, classes, rounds of exchange, broadcast counts, longest broadcast word.
UNITS, ENDINGS, CLASSES, ROUNDS, LOOKUP, WORD_BYTES = 12_000, 512, 64, 6, 200_000, 64
#: Most frequent units whose neighbours are exact within a sweep.
HEAD = 1024
#: The end token: no word holds white space.
END = b"\n"


def tokens(raw: bytes) -> list[bytes]:
    """A-Z to lower case, words between white space of ASCII, one end."""
    out = raw.lower().split()
    out.append(END)
    return out


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class _Units(dict):
    """Word to unit; words outside the table go to the unit of their ending. Bounded."""

    def __init__(self, own: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(own))
        self.first, self.limit = len(own), len(own) + 400_000
        self.own = own

    def __missing__(self, word: bytes) -> int:
        unit = self.first + ending(word)
        if len(word) <= WORD_BYTES:
            if len(self) >= self.limit:
                self.clear()
                self.update((w, i) for i, w in enumerate(self.own))
            self[word] = unit
        return unit


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), c over all tokens of ``texts`` (column text), the end token included."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for raw in binary_rows(batch, "text"):
                held.update(tokens(raw))
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return lean(texts.select("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, own: list[bytes]) -> DataFrame:
    """u, v, n: how often unit v follows unit u, the end token standing before each text."""
    shared = texts.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        units = _Units(shared.value)
        size = units.first + ENDINGS
        end, held, some = units[END], [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((keys // size).astype("int32")), pa.array((keys % size).astype("int32")), pa.array(n.astype("int64"))], names=["u", "v", "n"])

        for batch in batches:
            for raw in binary_rows(batch, "text"):
                row = np.array([end, *map(units.__getitem__, tokens(raw))], "int64")
                held.append(row[:-1] * size + row[1:])
                some += len(row)
                if some > 8_000_000:
                    yield out()
                    held, some = [], 0
        if held:
            yield out()

    return lean(texts.select("text")).mapInArrow(run, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _by_class(pairs: DataFrame, classes, size: int, k: int):
    """Matrices (units, classes): counts of successors and of predecessors of each unit by class."""
    import numpy as np

    shared = pairs.sparkSession.sparkContext.broadcast(np.asarray(classes, "int32"))

    def run(batches):
        import pyarrow as pa

        of, total = shared.value, {}
        for batch in batches:
            u, v, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "n"))
            for side, (a, b) in enumerate(((u, v), (v, u))):
                key = a.astype("int64") * k + of[b]
                add = np.bincount(key, weights=n, minlength=size * k)
                total[side] = total[side] + add if side in total else add
        for side, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, "int32")), pa.array(at), pa.array(found[at].astype("int64"))], names=["side", "at", "n"])

    out = np.zeros((2, size * k))
    rows = pairs.mapInArrow(run, "side int, at long, n long").groupBy("side", "at").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("side").to_numpy(), rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(2, size, k)


def _f(x):
    import numpy as np

    return x * np.log(np.maximum(x, 1e-12))


def objective(n) -> float:
    """The class part of the log-likelihood of class pair counts."""
    return float(_f(n).sum() - _f(n.sum(1)).sum() - _f(n.sum(0)).sum())


def exchange(after, before, head, classes, order):
    """One sweep: every unit to the class where the likelihood is highest; returns how many moved.

    Rows of ``after``, ``before``: a unit's neighbours by class as the sweep begins. ``head``: pair counts
    among the first units, whose neighbours are kept up to date within the sweep.
    """
    import numpy as np

    k, h = after.shape[1], len(head)
    n = np.zeros((k, k))
    np.add.at(n, classes, after)
    own = classes[:h]
    fixed_after, fixed_before = after[:h].copy(), before[:h].copy()
    for u in range(h):
        fixed_after[u] -= np.bincount(own, weights=head[u], minlength=k)
        fixed_before[u] -= np.bincount(own, weights=head[:, u], minlength=k)
    moved = 0
    for u in order:
        old, twice = classes[u], 0.0
        if u < h:
            own, twice = classes[:h], head[u, u]
            s = fixed_after[u] + np.bincount(own, weights=head[u], minlength=k)
            p = fixed_before[u] + np.bincount(own, weights=head[:, u], minlength=k)
            s[old] -= twice
            p[old] -= twice
        else:
            s, p = after[u], before[u]
        if not s.any() and not p.any():
            continue
        n[old] -= s
        n[:, old] -= p
        n[old, old] -= twice
        sd, pd = np.flatnonzero(s), np.flatnonzero(p)
        left, right, a, b = n.sum(1), n.sum(0), s.sum() + twice, p.sum() + twice
        pos = lambda x: _f(np.maximum(x, 0))
        gain = (pos(n[:, sd] + s[sd]) - pos(n[:, sd])).sum(1) + (pos(n[pd] + p[pd, None]) - pos(n[pd])).sum(0)
        gain -= pos(left + a) - pos(left) + pos(right + b) - pos(right)
        best = int(gain.argmax())
        if gain[best] <= gain[old] + 1e-9:
            best = old
        moved += best != old
        classes[u] = best
        n[best] += s
        n[:, best] += p
        n[best, best] += twice
    return moved


def cluster(pairs: DataFrame, weight, k: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD):
    """Class of each unit, and the class pair counts. ``weight``: a unit's frequency."""
    import numpy as np

    size = len(weight)
    order = np.argsort(-weight, kind="stable")
    classes = np.zeros(size, "int64")
    classes[order] = np.arange(size) % k  # the usual start: by frequency in turn
    h = min(head, size)
    rows = pairs.where((F.col("u") < h) & (F.col("v") < h)).toArrow()  # at most h * h rows
    dense = np.zeros((h, h), "float32")
    dense[rows.column("u").to_numpy(), rows.column("v").to_numpy()] = rows.column("n").to_numpy()
    best = None
    for step in range(rounds + 1):
        after, before = _by_class(pairs, classes, size, k)
        n = np.zeros((k, k))
        np.add.at(n, classes, after)
        value = objective(n)
        if best is None or value > best[0]:
            best = (value, classes.copy(), n)
        elif step > 2:
            break  # units that moved together did not fit together; the best round stays
        if step == rounds:
            break
        classes = classes.copy()
        if not exchange(after, before, dense, classes, order):
            break
    return best[1], best[2]


class BrownModel:
    """Frozen class bigram model: everything but the counts of rare words."""

    def __init__(self, own: list[bytes], classes, pairs, class_tokens, singletons, tokens: int, types: int, lookup: dict[bytes, int]):
        import numpy as np

        self.own, self.classes, self.lookup = own, np.asarray(classes, "int64"), lookup
        self.n, self.v = tokens, types
        share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
        total, kinds = pairs.sum(1), (pairs > 0).sum(1)
        spread = np.where(total > 0, total / np.maximum(total + kinds, 1), 0.0)[:, None]
        self.transition = np.log10(spread * pairs / np.maximum(total, 1)[:, None] + (1 - spread) * share[None, :])
        unseen = np.where(class_tokens > 0, (singletons + 0.5) / (class_tokens + 1), 1.0)
        self.unseen = np.log10(unseen)
        with np.errstate(divide="ignore"):
            self.seen = np.log10(1 - unseen) - np.log10(class_tokens)

    def emission(self, c: int, count: int) -> float:
        return self.seen[c] + math.log10(count) if count else self.unseen[c]


def _class_totals(counts: DataFrame, own: list[bytes], classes, k: int):
    """Tokens and words with one occurrence of each class, over the whole count table."""
    import numpy as np

    shared = counts.sparkSession.sparkContext.broadcast((own, np.asarray(classes, "int32")))

    def run(batches):
        import pyarrow as pa

        units, of = _Units(shared.value[0]), shared.value[1]
        for batch in batches:
            c = batch.column("c").to_numpy(zero_copy_only=False).astype("float64")
            at = of[np.array([units[w] for w in batch.column("word").to_pylist()], "int64")] if len(c) else np.zeros(0, "int32")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype="int32")), pa.array(np.bincount(at, weights=c, minlength=k).astype("int64")), pa.array(np.bincount(at, weights=c == 1, minlength=k).astype("int64"))], names=["class", "n", "once"])

    rows = counts.mapInArrow(run, "class int, n long, once long").groupBy("class").agg(F.sum("n"), F.sum("once")).collect()
    out = np.zeros((2, k))
    for r in rows:
        out[:, r[0]] = r[1], r[2]
    return out


def fit(texts: DataFrame, units: int = UNITS, k: int = CLASSES, rounds: int = ROUNDS, lookup: int = LOOKUP) -> tuple[BrownModel, DataFrame]:
    """The model over all rows of ``texts`` (column text), and the full count table (word, c)."""
    import numpy as np

    counts = written(count_words(texts), "counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.where(F.length("word") <= WORD_BYTES).orderBy(F.desc("c"), "word").limit(max(units, lookup)).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_pylist()
    own = words[:units]
    if END not in own:
        own = [END, *own[: units - 1]]
    pairs = written(count_pairs(texts, own), "pairs")
    size = len(own) + ENDINGS
    weight = np.zeros(size)
    total = pairs.groupBy("v").agg(F.sum("n").alias("n")).toArrow()
    weight[total.column("v").to_numpy()] = total.column("n").to_numpy()
    classes, joint = cluster(pairs, weight, k, rounds)
    tokens_of, once = _class_totals(counts, own, classes, k)
    return BrownModel(own, classes, joint, tokens_of, once, n or 0, v or 0, dict(zip(words[:lookup], c))), counts


def score(docs: DataFrame, model: BrownModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to ``carry``, n_tokens, n_known, base_score (add-one unigram) and score (class model), log10 over the whole text, of each row."""
    extra = [*carry]
    source = docs.select(F.col(id_col).alias("id"), *extra, text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        units, class_of, of, look = _Units(m.own), m.classes, m.classes.tolist(), m.lookup
        end = of[units[END]]
        fixed = {w: (math.log10(c + 1), m.emission(of[units[w]], c)) for w, c in look.items()}
        unit, known_word = units.__getitem__, fixed.get
        for batch in batches:
            n, known, base, own = [], [], [], []
            # the rare words of all rows in flat columns, and where each row's begin
            at, words_, classes_, counts_ = [0], [], [], []
            for raw in binary_rows(batch, "text"):
                words = tokens(raw)
                path = class_of[np.fromiter(map(unit, words), "int64", len(words))]
                step = m.transition[end, path[0]] + m.transition[path[:-1], path[1:]].sum()
                b = e = 0.0
                seen = 0
                for w, c in Counter(words).items():
                    x = known_word(w)
                    if x is not None:
                        b += c * x[0]
                        e += c * x[1]
                        seen += c
                    else:
                        words_.append(w)
                        classes_.append(of[unit(w)])
                        counts_.append(c)
                at.append(len(words_))
                n.append(len(words))
                known.append(seen)
                base.append(b)
                own.append(float(step + e))
            rest = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(classes_, pa.int32()), pa.array(counts_, pa.int64())], names=["w", "k", "n"]))
            columns = [batch.column("id"), *(batch.column(x) for x in extra), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), rest]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *extra, "n_tokens", "known", "base", "own", "rare"])

    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {''.join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in extra)}n_tokens long, known long, base double, own double, rare array<struct<w:binary,k:int,n:long>>"
    rows = written(lean(source).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.k").alias("k"), F.col("x.n").alias("n"))
    met = rare.join(counts.withColumnRenamed("c", "found"), "word", "left")
    table = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    emit = F.when(F.col("found").isNull(), F.element_at(table(model.unseen), F.col("k") + 1)).otherwise(F.element_at(table([max(x, -1e9) for x in model.seen]), F.col("k") + 1) + F.log10("found"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("found").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(F.coalesce("found", F.lit(0)) + 1)).alias("b"),
        F.sum(F.col("n") * emit).alias("e"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    floor = math.log10(model.n + model.v + 1)
    return rows.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        *extra,
        "n_tokens",
        (F.col("known") + zero("more")).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("own") + zero("e")).alias("score"),
    )


def held_out_scores(docs: DataFrame) -> DataFrame:
    """The query's form: train where crc32(doc_id) mod 7 is not 2, score every row."""
    rows = docs.select("doc_id", (fold(7) == 2).alias("held_out"), text_or_empty().alias("text"))
    return score(rows, *fit(rows.where("NOT held_out").select("text")), carry=("held_out",))
