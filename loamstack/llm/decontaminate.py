"""Operator 2: benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions, answers) and documents are normalised alike: A-Z to
lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Each run of
``window`` consecutive item words is a pattern (a shorter item is one pattern).
All patterns form one automaton that reads a normalised document once; a match
is mapped back to word numbers and to character offsets of the original text.

The automaton is built on the driver and broadcast only while the benchmark's
text is at most ``slice_bytes``; a larger benchmark is divided by hash into
slices below that size, whose automata pass over the documents one after the
other, with the state between two passes in a written table.

Defined cases: null text has no words; an item without words matches nothing; a
null item id is written as the empty string; equal windows of several items hit all of them.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, lean, text_or_empty, unused, written

#: Words of the contract, on text in which A-Z are still upper case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Upper case to lower case, separators to a space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SLICE_BYTES = 16 << 20


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def patterns(items: list[tuple[str, bytes]], window: int) -> dict[str, tuple[int, list[int]]]:
    """Pattern (a space on either side; bytes as Latin-1) to its number of words and its items."""
    found: dict[str, tuple[int, list[int]]] = {}
    for k, (_, raw) in enumerate(items):
        words = words_of(raw)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            own = found.setdefault(f" {b' '.join(words[i : i + n]).decode('latin-1')} ", (n, []))[1]
            if not own or own[-1] != k:
                own.append(k)
    return found


class Scanner:
    """One automaton over the patterns of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.ids, self.machine = [i for i, _ in items], ahocorasick.Automaton()
        for text, found in patterns(items, window).items():
            self.machine.add_word(text, found)
        if len(self.machine):
            self.machine.make_automaton()
        else:
            self.machine = None

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [first, last] of the matches, and the ids of the items that occur."""
        import numpy as np

        if not self.machine or not words:
            return [], set()
        hits = list(self.machine.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not hits:
            return [], set()
        ends = np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, [e for e, _ in hits])
        spans = {(int(j) - n + 1, int(j)) for j, (_, (n, _)) in zip(last, hits)}
        return sorted(spans), {self.ids[k] for _, (_, items) in hits for k in items}


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint intervals with the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of word intervals."""
    import re

    at = [m.span() for m in re.finditer(WORD, text)]
    return [(at[a][0], at[b][1]) for a, b in spans]


_LOADED: dict[str, Scanner] = {}


def _scanner(items, key: str, window: int) -> Scanner:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Scanner(items.value, window)
    return _LOADED[key]


def _slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int):
    """The benchmark's items, at most about ``slice_bytes`` at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / slice_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield k == n - 1, [(r["item"], r["text"].encode()) for r in part.collect()]


def _scan(docs: DataFrame, benchmark: DataFrame, finish, schema: str, text_col: str, item_id: str, item_text: str, window: int, slice_bytes: int) -> DataFrame:
    """Pass the slices over the documents; ``finish(batch, rows)`` makes the last pass's output from (number of words, spans, items) of each row."""
    spark, current, (state_name,) = docs.sparkSession, docs, unused(docs, "hits")
    for last, items in _slices(benchmark, item_id, item_text, slice_bytes):
        shared, key = spark.sparkContext.broadcast(items), hashlib.sha256(repr((window, items)).encode()).hexdigest()

        def run(batches, shared=shared, key=key, last=last):
            import pyarrow as pa

            scanner = _scanner(shared, key, window)
            for batch in batches:
                old = batch.column(state_name).to_pylist() if state_name in batch.schema.names else None
                rows = []
                for i, raw in enumerate(binary_rows(batch, text_col)):
                    words = words_of(raw)
                    spans, found = scanner.scan(words)
                    if old:
                        spans = [*spans, *((x["a"], x["b"]) for x in old[i]["spans"])]
                        found |= set(old[i]["items"])
                    rows.append((len(words), merged(spans), found))
                if old is not None:
                    batch = batch.select([n for n in batch.schema.names if n != state_name])
                if last:
                    yield from finish(batch, rows)
                else:
                    kind = pa.struct([("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
                    state = pa.array([{"spans": [{"a": a, "b": b} for a, b in s], "items": sorted(f)} for _, s, f in rows], kind)
                    yield pa.RecordBatch.from_arrays([*batch.columns, state], names=[*batch.schema.names, state_name])

        if last:
            return lean(current).mapInArrow(run, schema)
        from pyspark.sql.types import StructField, StructType, _parse_datatype_string

        hits = _parse_datatype_string("struct<spans:array<struct<a:int,b:int>>,items:array<string>>")
        current = written(lean(current).mapInArrow(run, StructType([*docs.schema.fields, StructField(state_name, hits)])), "passes")
    raise AssertionError("there is always a last slice")


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """For each row: id_col, n_words, n_hit, items (sorted ids), spans (character offsets of hit passages in the original text)."""
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def finish(batch, rows):
        import pyarrow as pa

        texts = batch.column("text")
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        places = [[{"start": a, "end": b} for a, b in offsets(texts[i].as_py(), s)] if s else [] for i, (_, s, _) in enumerate(rows)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([sum(b - a + 1 for a, b in s) for _, s, _ in rows], pa.int64()),
                pa.array([sorted(f) for _, _, f in rows], pa.list_(pa.string())),
                pa.array(places, span),
            ],
            names=["id", "n_words", "n_hit", "items", "spans"],
        )

    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    return _scan(source, benchmark, finish, schema, "text", item_id, item_text, window, slice_bytes).withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns as they are."""

    def finish(batch, rows):
        import pyarrow as pa

        yield batch.filter(pa.array([not s for _, s, _ in rows], pa.bool_()))

    return _scan(docs, benchmark, finish, docs.schema, text_col, item_id, item_text, window, slice_bytes)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan_documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan_documents(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
