"""Operator 5: language identification by prediction by partial matching.

For each language the counts of a bounded training sample freeze into a byte
context tree of orders 0 to ``max_order``. The code length of a byte is that of
PPM method C without exclusions: in the longest context of the tree the byte
costs -log2(n(c, b) / (n(c) + d(c))) if it occurred there, else the escape
-log2(d(c) / (n(c) + d(c))) and then its cost in the next shorter context; below
order 0 every byte costs 8 bits. A text gets the language with the least total.

The trees of all languages share one dictionary of byte strings. An executor
walks it for all bytes of a batch at once: the number of the string of length k
that ends at a byte follows from the number of length k-1 that ends before it.
Only bytes whose longest string is missing go down to shorter contexts.

Letters are folded to lower case within ASCII and Latin-1. Every string that the
sample holds is in the trees. Defined cases: null text, or text without a letter, is
``und`` with score 0; without any training row every text is ``und``; very long texts
are read part by part; repeated rows get the same result; of equal code lengths the
language first by name is taken; a null id counts as the empty text in the fold; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_column, fold, lean, text_or_empty, written
from loamstack.llm.sampling import sampled

#: Bounds of the labelled sample: training rows of a language, bytes of a training row. Longest context.
ROWS_PER_LANGUAGE, ROW_BYTES, MAX_ORDER = 1500, 1 << 16, 4
#: Cells of a table from (string, byte) to the longer string; beyond, the sorted keys are searched instead.
DENSE = 1 << 25


def folded(data):
    """Bytes with A-Z and the Latin-1 capitals (U+00C0 to U+00DE) in lower case."""
    import numpy as np

    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        out[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


class ContextTrees:
    """Frozen trees of all languages: for each length k, strings as (number of the first k-1 bytes, last byte)."""

    def __init__(self, languages: list[str], counts: list[dict[bytes, list[int]]]):
        import numpy as np

        self.languages, self.depth = languages, len(counts)
        self.keys, self.costs, self.escapes = [], [], []
        ids: list[dict[bytes, int]] = [{b"": 0}]
        below = None
        n_lang = len(languages)
        for k, own in enumerate(counts, 1):
            strings = sorted(own)
            number = {s: i + 1 for i, s in enumerate(strings)}
            table = np.array([own[s] for s in strings], "float64").reshape(len(strings), n_lang)
            parent = np.array([ids[-1][s[:-1]] for s in strings], "int64")
            parents = len(ids[-1]) + (k > 1)
            total, kinds = np.zeros((parents, n_lang)), np.zeros((parents, n_lang))
            np.add.at(total, parent, table)
            np.add.at(kinds, parent, table > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(table / (total + kinds)[parent])
            lower = np.full((len(strings), n_lang), 8.0) if k == 1 else below[[ids[-1][s[1:]] for s in strings]]
            cost = np.where(table > 0, seen, escape[parent] + lower)
            below = np.concatenate([np.zeros((1, n_lang)), cost])
            self.keys.append(parent * 256 + np.array([s[-1] for s in strings], "int64"))
            self.costs.append(below.astype("float32"))
            self.escapes.append(escape.astype("float32"))
            ids.append(number)

    def tables(self, dense: int = DENSE):
        """Dense tables from (number, byte) to the longer string's number, or its sorted keys and their order where a table would be large."""
        import numpy as np

        self._next = []
        for k in range(self.depth):
            size = 1 if k == 0 else len(self.costs[k - 1])
            if size * 256 <= dense or not len(self.keys[k]):
                table = np.zeros(size * 256, "int32")
                table[self.keys[k]] = np.arange(1, len(self.keys[k]) + 1)
                self._next.append(table)
            else:
                order = np.argsort(self.keys[k], kind="stable")
                self._next.append((self.keys[k][order], (order + 1).astype("int32")))
        return self

    def _longer(self, k: int, at):
        """The numbers of the strings of k + 1 bytes with the keys ``at``, 0 where there is none."""
        import numpy as np

        if not isinstance(self._next[k], tuple):
            return self._next[k][at]
        keys, number = self._next[k]
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[place] == at, number[place], 0)

    def code_lengths(self, data, starts):
        """Bits of each text for each language. ``data``: the bytes of all texts; ``starts``: where each begins."""
        import numpy as np

        x = folded(data).astype("int64")
        n, ids = len(x), []
        inner = starts[starts < n]
        prev = np.zeros(n, "int64")
        for k in range(self.depth):
            here = self._longer(k, prev * 256 + x).astype("int64")
            if k:
                here[prev == 0] = 0
            ids.append((prev, here))
            prev = np.empty(n, "int64")
            prev[1:] = here[:-1]
            prev[inner] = 0
        cost = self.costs[-1][ids[-1][1]]
        todo = np.flatnonzero(ids[-1][1] == 0)
        spent = np.zeros((len(todo), len(self.languages)), "float32")
        for k in range(self.depth - 1, -1, -1):
            prev, here = ids[k][0][todo], ids[k][1][todo]
            found = here > 0
            cost[todo[found]] = spent[found] + self.costs[k][here[found]]
            rest = ~found
            todo, spent = todo[rest], spent[rest] + self.escapes[k][prev[rest]] * (1 if k == 0 else (prev[rest] > 0)[:, None])
        cost[todo] = spent + 8
        out = np.zeros((len(starts), len(self.languages)))
        lengths = np.diff(np.append(starts, n))
        some = lengths > 0
        if some.any():
            out[some] = np.add.reduceat(cost, starts[some], axis=0, dtype="float64")
        return out


def _counted(rows: DataFrame, max_order: int) -> DataFrame:
    """lang, string, n over the strings of 1 to max_order + 1 bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = {}
            for lang, raw in zip(batch.column("lang").to_pylist(), binary_column(batch, "text")):
                texts.setdefault(lang, []).append(raw)
            for lang, own in texts.items():
                for k in range(1, max_order + 2):
                    values = []
                    for raw in own:
                        data = folded(np.frombuffer(raw, "uint8")).astype("uint64")
                        if len(data) >= k:
                            value = np.zeros(len(data) - k + 1, "uint64")
                            for j in range(k):
                                value = value * np.uint64(256) + data[j : len(data) - k + 1 + j]
                            values.append(value)
                    if values:
                        keys, n = np.unique(np.concatenate(values), return_counts=True)
                        strings = [int(v).to_bytes(k, "big") for v in keys]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(strings, pa.binary()), pa.array(n, pa.int64())], names=["lang", "string", "n"])

    return lean(rows).mapInArrow(run, "lang string, string binary, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, max_order: int = MAX_ORDER) -> ContextTrees | None:
    """Trees of all strings of about ``rows_per_language`` rows of each language of at most ROW_BYTES bytes; these counts go to the driver."""
    known = rows.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(f"lang IS NOT NULL AND octet_length(text) <= {ROW_BYTES}")
    counted = _counted(sampled(known, ["id"], rows_per_language, "lang").select("text", "lang"), max_order)
    # the counts of a bounded sample, made once for all lengths
    table = written(counted.groupBy("string").agg(F.collect_list(F.struct("lang", "n")).alias("by")).withColumn("k", F.length("string")), "strings")
    counts, languages = [], set()
    for k in range(1, max_order + 2):
        found = table.where(F.col("k") == k).select("string", "by").toArrow()
        counts.append([(s, {x["lang"]: x["n"] for x in by}) for s, by in zip(found.column("string").to_pylist(), found.column("by").to_pylist())])
        languages.update(x for _, by in counts[-1] for x in by)
    names = sorted(languages)
    if not names:
        return None
    return ContextTrees(names, [{s: [by.get(x, 0) for x in names] for s, by in own} for own in counts])


def identify(docs: DataFrame, model: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score (posterior of equal priors), bits (code length) for each row."""
    source = docs.select(F.col(id_col).alias("id"), (fold(5, id_col) == 0).alias("held_out"), text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trees = shared.value
        if trees is not None and not hasattr(trees, "_next"):
            trees.tables()
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            texts = binary_column(batch, "text")
            langs, scores, bits = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            i = 0
            while i < len(texts) and trees is not None:
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                    size += len(texts[j])
                    j += 1
                total = _whole(trees, texts[i]) if size > 1 << 22 else trees.code_lengths(np.frombuffer(b"".join(texts[i:j]), "uint8"), np.cumsum([0, *map(len, texts[i : j - 1])]))
                for r in range(i, j):
                    if letter[np.frombuffer(texts[r], "uint8")].any() or any(map(str.isalpha, texts[r].decode("utf-8", "replace"))):
                        own = total[r - i]
                        best = int(own.argmin())
                        langs[r], bits[r] = trees.languages[best], float(own[best])
                        scores[r] = float(1 / np.exp2(np.maximum(own[best] - own, -1000.0)).sum())
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=["id", "held_out", "lang_pred", "score", "bits"])

    return lean(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)


def _whole(trees: ContextTrees, raw: bytes, part: int = 1 << 20):
    """Code lengths of one very long text, part by part; a part is preceded by its context, whose own cost is left out."""
    import numpy as np

    total, k = np.zeros((1, len(trees.languages))), trees.depth - 1
    for i in range(0, len(raw), part):
        before = raw[max(0, i - k) : i]
        both = np.frombuffer(before + raw[i : i + part], "uint8")
        zero = np.zeros(1, "int64")
        total += trees.code_lengths(both, zero)
        if before:
            total -= trees.code_lengths(np.frombuffer(before, "uint8"), zero)
    return total


def languages(docs: DataFrame) -> DataFrame:
    """The query's form: learn from rows outside the held-out fold, predict every row."""
    return identify(docs, fit(docs.where(fold(5) != 0)))
