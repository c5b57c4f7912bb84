"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE file of the tokenizers library, tokenizer B a model of sentencepiece that puts a space before
the text; A gets the same space. The libraries' spans are the coarse cuts: A's character offsets and the begin and end
of B's pieces (the ``proto`` of the installed sentencepiece, which has taken the place of its immutable proto). Where
a token ends within a character, or a byte fallback or the added space makes a span wrong, the end follows from the token's
own bytes, and every token's bytes are compared with the text, so that no span is taken on trust.

Neither tokenizer has a token across the place where a space or line end follows a character that is no white space, or where a
stop follows a Latin letter: A's expression starts a new piece there, B has no piece that holds such a place (checked when it is
loaded). So texts are cut there into chunks, mostly words, and a worker keeps what it has found for a chunk. Spark carries the rest: the links of all
documents are counted by a shuffle on the pair of ids, the counts come back to the documents by a join.

Per document: doc_id, n_a, n_b (tokens), n_groups (runs between byte offsets at which tokens of both end), n_links (pairs of
tokens that overlap), n_best (links whose pair is, corpus-wide, the most frequent of its B id, ties included), count_sum
(corpus-wide counts of the links' pairs, summed) and groups_sha256.

Defined cases: a null or empty text, and one whose tokens of A or B do not join to it (it holds U+2581, say), has no tokens:
zeros and ''; every row is a document of its own, also where ids repeat or are null; very long texts go
through block by block; an empty table stays empty; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.bpe_transducer import byte_alphabet
from loamstack.llm.common import binary_rows, lean, written

#: A chunk, up to a place where texts are cut: a Latin word up to a space, line end or stop; a stop up to white space; or else all up to a
#: space or line end behind a character that is no white space. And places that no token of B may hold.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_CHUNK = re.compile(rf"[ \n][{_LATIN}]++(?=[ \n.,;:!?])|[.,;:!?](?=[ \n])|\s*+\S++(?:[^\S \n]\s*+\S*+)*+|\s+")
_HELD = re.compile(rf"\n|[^ ] |[{_LATIN}][.,;:!?]")
#: Longest text whose chunks are in hand at once, chunks in hand of longer ones; chunks and their bytes that a worker keeps.
WHOLE, BLOCK, MEMO_CHUNKS, MEMO_BYTES = 1 << 20, 50_000, 600_000, 96 << 20
#: Pairs of ids whose counts are broadcast, the most frequent ones; all others are joined by a shuffle.
BROADCAST_PAIRS = 1 << 18
SPACE_MARK = "▁"


class NoTokens(Exception):
    """The tokens of a text do not join to it."""


def ends(raw: bytes, ids: list[int], names: list[bytes], sizes, coarse):
    """Where each token ends in ``raw`` (an array), from the coarse ends of the library, corrected by the tokens' bytes."""
    import numpy as np

    if b"".join([names[i] for i in ids]) != raw:
        raise NoTokens
    fine = np.cumsum(sizes[np.array(ids, "i8")])
    # where a token is a part of a character, a fallback byte or has a space added, its own bytes tell its end
    return np.where(coarse == fine, coarse, fine)


def in_bytes(text: str, coarse):
    """Ends in characters as ends in bytes."""
    import numpy as np

    if text.isascii():
        return coarse
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    reach = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype("i8"))
    return np.concatenate(([0], reach))[coarse]


class Aligner:
    """Both tokenizers, and what is known of the chunks seen so far."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        names = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.size = len(self.b)
        self.a_names = [self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), "i8") for x in (self.a_names, self.b_bytes))
        # whether a text may be cut: no piece holds such a place, and a line end is a fallback byte
        self.cuts = not any(_HELD.search(x.replace(SPACE_MARK, " ")) for x in names) and not self.b.is_unknown(self.b.piece_to_id(SPACE_MARK)) and self.b.id_to_piece(self.b.encode("\n")[-1]) == "<0x0A>"
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.place: dict[str, int] = {}
        self.groups, self.links, self.kept = [], [], 0
        #: n_a, n_b, n_groups, n_links of each chunk kept; -1 where its tokens do not join to it.
        self.facts = np.zeros((1024, 4), "i8")
        #: In how many blocks of text each was found since chunks were last given up.
        self.uses = np.zeros(1024, "i4")

    def thin(self) -> None:
        """Give up the chunks that were found once since the last time, and half of all at least; what is frequent is not learnt again."""
        import numpy as np

        n = len(self.groups)
        often = np.argsort(-self.uses[:n], kind="stable")[: min(n, MEMO_CHUNKS) // 2]
        often = np.sort(often[self.uses[often] > 1])
        names, groups, links, facts = list(self.place), self.groups, self.links, self.facts[often]
        self.clear()
        self.groups, self.links = ([x[i] for i in often.tolist()] for x in (groups, links))
        self.place = {names[i]: k for k, i in enumerate(often.tolist())}
        self.facts = np.concatenate([facts, self.facts])
        self.uses = np.zeros(len(self.facts), "i4")
        self.kept = sum(2 * len(c) + len(g) + len(x) for c, g, x in zip(self.place, self.groups, self.links, strict=True))
        if self.kept > MEMO_BYTES // 2:
            self.clear()

    def chunks(self, text: str):
        """Lists of chunks of the text with its space before it."""
        text = " " + text
        if not self.cuts:
            yield [text]
        elif len(text) <= WHOLE:
            yield _CHUNK.findall(text)
        else:
            found = (m.group() for m in _CHUNK.finditer(text))
            while block := list(itertools.islice(found, BLOCK)):
                yield block

    def _of_b(self, text: str) -> tuple[list[int], object]:
        """ids and coarse ends (in bytes) of B's tokens of a text that begins where texts are cut.

        B adds the space that the text begins with. To others it adds one that is taken off again, behind a line end that keeps it apart.
        """
        import numpy as np

        if text == " ":  # of nothing B makes nothing
            return [self.space], np.ones(1, "i8")
        asked, drop, shift = (text[1:], 0, 1) if text[0] == " " else (text, 1, 0) if text[0] == "\n" else ("\n" + text, 2, -1)
        pieces = list(self.b.encode(asked, return_type="proto").pieces)[drop:]
        return [x.id for x in pieces], np.fromiter((x.end for x in pieces), "i8", len(pieces)) + shift

    def _align(self, chunks: list[str]) -> list[tuple[tuple[int, int, int, int], bytes, bytes]]:
        """Counts, groups and links of chunks that may stand behind each other in this order."""
        import numpy as np

        text = "".join(chunks)
        raw, seen = text.encode(), self.a.encode(text, add_special_tokens=False)
        a, b, coarse = seen.ids, *self._of_b(text)
        spans = np.fromiter(itertools.chain.from_iterable(seen.offsets), "i8", 2 * len(a))
        a_ends = ends(raw, a, self.a_names, self.a_sizes, in_bytes(text, spans[1::2]))
        b_ends = ends(raw, b, self.b_bytes, self.b_sizes, coarse)
        stops = np.cumsum([len(c.encode()) for c in chunks])
        both = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        # tokens overlap once in each stretch between two ends of any
        every = np.union1d(a_ends, b_ends)
        codes = np.array(a, "i8")[np.searchsorted(a_ends, every)] * self.size + np.array(b, "i8")[np.searchsorted(b_ends, every)]
        cut_a, cut_b = (np.searchsorted(x, both, "right").tolist() for x in (a_ends, b_ends))
        upto = [np.searchsorted(x, stops, "right") for x in (a_ends, b_ends, both, every)]
        counts = np.diff(np.array(upto), axis=1, prepend=0).T.tolist()
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups = [f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)]  # noqa: B905
        out, g, e = [], 0, 0
        for fact, h, f in zip(counts, upto[2].tolist(), upto[3].tolist(), strict=True):
            out.append((tuple(fact), ";".join(groups[g:h]).encode(), codes[e:f].tobytes()))
            g, e = h, f
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode and align chunks that are not known yet: those that may stand behind each other together, others, and all if that fails, one by one."""
        import numpy as np

        follow = [c for c in chunks if c[0] in " \n" and not c[-1].isspace()]
        alone = [c for c in chunks if not (c[0] in " \n" and not c[-1].isspace())]
        found: list = []
        try:
            found = self._align(follow) if follow else []
        except NoTokens:
            alone = [*follow, *alone]
            follow = []
        for chunk in alone:
            try:
                found += self._align([chunk])
            except NoTokens:
                found.append(((-1, -1, -1, -1), b"", b""))
        n = len(self.groups)
        while n + len(found) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.facts[n : n + len(found)] = [x[0] for x in found]
        self.groups += [x[1] for x in found]
        self.links += [x[2] for x in found]
        self.place.update(zip([*follow, *alone], range(n, n + len(found)), strict=True))
        self.kept += sum(2 * len(c) + len(x[1]) + len(x[2]) for c, x in zip([*follow, *alone], found, strict=True))

    def document(self, text: str) -> tuple[tuple[int, int, int, int], str, object, object]:
        """The counts of a text (n_a, n_b, n_groups, n_links), its groups' digest, its distinct pairs as codes and how often it links each."""
        import numpy as np

        none = (0, 0, 0, 0), "", np.zeros(0, "i8"), np.zeros(0, "i4")
        if not text or SPACE_MARK in text:
            return none
        totals, digest, between, parts = np.zeros(4, "i8"), hashlib.sha256(), b"", []
        for block in self.chunks(text):
            if self.kept > MEMO_BYTES or len(self.groups) > MEMO_CHUNKS:
                self.thin()
            if new := [c for c in dict.fromkeys(block) if c not in self.place]:
                self.learn(new)
            at = list(map(self.place.__getitem__, block))
            places, times = np.unique(at, return_counts=True)
            self.uses[places] += 1
            facts = self.facts[places]
            if (facts < 0).any():
                return none
            totals += times @ facts
            digest.update(between + b";".join(map(self.groups.__getitem__, at)))
            between = b";"
            codes = [self.links[i] for i in places.tolist()]
            parts.append(_summed(np.frombuffer(b"".join(codes), "<i8"), np.repeat(times, facts[:, 3])))
        codes, times = parts[0] if len(parts) == 1 else _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return tuple(map(int, totals)), digest.hexdigest(), codes, times.astype("i4")


def _summed(codes, times):
    """Distinct codes in order with the sums of their times."""
    import numpy as np

    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(times, first)


_LOADED: dict[int, Aligner] = {}


def _aligner(spec) -> Aligner:
    """One aligner for each worker and pair of tokenizers."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(*spec.value)
    return _LOADED[key]


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times. Both files are read by the driver (some 2 MB) and sent to the executors."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        spec = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        both = _aligner(spec)
        for batch in batches:
            rows = [both.document(raw.decode("utf-8", "replace")) for raw in binary_rows(batch, "text")]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
            reach = pa.array([0, *itertools.accumulate(len(r[2]) for r in rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(reach, pa.concat_arrays([pa.array(r[k], kind) for r in rows]) if rows else pa.array([], kind)) for k, kind in ((2, pa.int64()), (3, pa.int32()))]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([r[1] for r in rows], pa.string()), *lists], names=names)

    return lean(source).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>")


def pair_counts(rows: DataFrame, size: int) -> DataFrame:
    """code, n, best of every pair of ids linked anywhere: its links, and whether no pair of its B id (code modulo ``size``) has more."""
    pairs = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("x")).select("x.codes", "x.times")
    counts = written(pairs.groupBy(F.col("codes").alias("code")).agg(F.sum("times").alias("n")), "op13-counts")
    own = F.pmod("code", F.lit(size))
    most = counts.groupBy(own.alias("b")).agg(F.max("n").alias("most"))
    # one row for each id of B's vocabulary at most
    return counts.withColumn("b", own).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` pairs reach, on a scale of quarter powers of two."""
    level = F.floor(4 * F.log2("n")).cast("int")
    n = 0
    for k, more in sorted(pairs.groupBy(level.alias("k")).count().collect(), reverse=True):  # a few hundred levels
        n += more
        if n > most:
            return int(2 ** ((k + 1) / 4)) + 1
    return 0


def alignment(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int | None = None) -> DataFrame:
    """One row for each document, see above."""
    import sentencepiece

    size = len(sentencepiece.SentencePieceProcessor(model_file=b_path))
    rows = written(encoded(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "op13-documents")
    pairs = written(pair_counts(rows, size), "op13-pairs")
    least = _frequent(pairs, BROADCAST_PAIRS if broadcast_pairs is None else broadcast_pairs)
    links = rows.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    frequent = pairs.where(F.col("n") >= least)
    sums = summed(links.join(F.broadcast(frequent), "code"))
    if least:  # a pair under the bound is no hot key
        rare = links.join(F.broadcast(frequent.select("code")), "code", "left_anti")
        sums = sums.unionByName(summed(rare.join(pairs.where(F.col("n") < least), "code"))).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
