"""Operator 8: byte-level BPE as a bounded-lookahead streaming transducer.

Encoding. A boundary between two bytes disappears only when a merge (u, v)
crosses it. Left of the boundary everything is known; right of it the merge
needs v whole, and v is at hand only if no earlier merge has joined the right
edge of v to what follows. So the bytes that must be seen right of the boundary
for merge k are

    need(k) = len(v) + max(need(j) for j < k whose left operand is on v's right spine)

and ``MergeTable.lookahead``, the largest need(k), suffices for the whole merge
list. ``encode_stream`` holds a window of that many bytes beyond what it has
emitted: tokens that end ``lookahead`` or more bytes before the window's end are
stable and leave at once, so memory does not grow with the piece. Pieces that
fit in one window (almost all) are kept in a bounded memo.

Decoding. ``ByteToText`` is an incremental state machine from bytes to text; it
holds back at most three bytes of an unfinished character and replaces invalid
sequences as lossy UTF-8 decoding does.

Null text is encoded as the empty text (no tokens). Any other row gives one row.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, lean, text_or_empty

#: White space of Unicode, as the tokenizer's expression counts it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Public pre-tokenization expression of byte-level BPE (fixed value).
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters of text that are cut into pieces at a time.
BLOCK = 1 << 18
#: Pieces kept in the memo of a worker, and the longest piece kept there.
MEMO_PIECES, MEMO_BYTES = 200_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, by the public rule: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """A vocabulary and its ordered merges, with the lookahead that they need."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.tokens, self.special = tokens, special or {}
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: s.encode() for s, i in self.special.items()}
        self.base = [tokens.get(bytes([b]), -1) for b in range(256)]
        self.ranks = {(tokens[a], tokens[b]): (rank, tokens[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.lookahead = sufficient_lookahead(merges)

    @classmethod
    def from_json(cls, text: str) -> MergeTable:
        spec, alphabet = json.loads(text), byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        tokens = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        return cls(tokens, [(raw(a), raw(b)) for a, b in pairs], special)

    def encode_window(self, piece: bytes) -> list[int]:
        """Apply the merges to one window, lowest rank first and leftmost among equals."""
        ids = [self.base[b] for b in piece]
        return self._few(ids) if len(ids) <= 48 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        get, none = self.ranks.get, (1 << 60, -1)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none or best[1] < 0:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], bytearray(b"\x01") * n
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := get((new, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, new, ids[after[i]], r[1]))
            if before[i] >= 0 and (r := get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], ids[before[i]], new, r[1]))
        return [x for x, live in zip(ids, alive) if live]

    def encode_stream(self, piece: bytes, window: int = 4096) -> Iterator[list[int]]:
        """Emit the tokens of a piece of any length as soon as they are stable."""
        ahead, start = self.lookahead, 0
        size = window + ahead
        while len(piece) - start > size:
            end, stable = start, []
            for token in self.encode_window(piece[start : start + size]):
                if (to := end + len(self.bytes_of[token])) > start + size - ahead:
                    break
                stable.append(token)
                end = to
            if stable:
                yield stable
                start = end
            else:
                size += window
        yield self.encode_window(piece[start:])


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes right of a boundary that decide whether any merge crosses it."""
    spine: dict[bytes, frozenset[bytes]] = {}
    by_left: dict[bytes, int] = {}
    most = 1
    for a, b in merges:
        edge = spine.get(b, frozenset()) | {b}
        need = len(b) + max((by_left.get(x, 0) for x in edge), default=0)
        by_left[a] = max(by_left.get(a, 0), need)
        spine[a + b] = spine.get(a + b, frozenset()) | edge
        most = max(most, need)
    return most


class ByteToText:
    """Incremental bytes to text: feed() gives what is settled, end() the rest."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


class _Memo(dict):
    """Token ids of a piece as little-endian bytes; cleared when full."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = array("I")
        for part in self.table.encode_stream(raw) if len(raw) > 1024 else (self.table.encode_window(raw),):
            ids.extend(part)
        out = ids.tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = out
        return out


class Transducer:
    """Text to ids and back, block by block."""

    def __init__(self, table: MergeTable):
        import regex

        self.table, self.memo = table, _Memo(table)
        self._pieces = regex.compile(_PIECES).findall
        self._cut = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])").search
        self._special = regex.compile("(" + "|".join(map(regex.escape, table.special)) + ")").split if table.special else lambda text: [text]
        self._bytes = [table.bytes_of.get(i, b"") for i in range(max(table.bytes_of, default=0) + 1)]

    def blocks(self, text: str) -> Iterator[str]:
        """Cut where white space follows something else: no piece spans that."""
        start = 0
        while len(text) - start > BLOCK:
            found = self._cut(text, start + BLOCK)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the text, as little-endian unsigned 32-bit integers, in blocks."""
        memo = self.memo
        for k, part in enumerate(self._special(text)):
            if k % 2:
                yield self.table.special[part].to_bytes(4, "little")
            elif part:
                for block in self.blocks(part):
                    yield b"".join([memo[x] for x in self._pieces(block)])

    def decode(self, ids: Iterator[bytes]) -> Iterator[str]:
        """Text of blocks of ids."""
        import numpy as np

        machine, of = ByteToText(), self._bytes.__getitem__
        for block in ids:
            yield machine.feed(b"".join(map(of, np.frombuffer(block, "<u4").tolist())))
        yield machine.end()


_LOADED: dict[int, Transducer] = {}


def _transducer(spec) -> Transducer:
    """One transducer for each worker and vocabulary."""
    key = hash(spec.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(MergeTable.from_json(spec.value))
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text.

    ``vocabulary`` is the path, readable by the driver, of a byte-level BPE file
    of the tokenizers library; the file (a fixed vocabulary, about 2 MB) is sent
    to the executors. Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with
    ``keep_ids``, the ids (array of int) and the decoded text.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        machine = _transducer(spec)
        for batch in batches:
            counts, hashes, back, kept, texts = [], [], [], [], []
            for raw in binary_rows(batch, "text"):
                own, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                ids, out = [], []

                def seen(blocks):
                    nonlocal n
                    for block in blocks:
                        n += len(block) // 4
                        own.update(block)
                        if keep_ids:
                            ids.append(block)
                        yield block

                for part in machine.decode(seen(machine.encode(raw.decode("utf-8", "replace")))):
                    decoded.update(part.encode())
                    if keep_ids:
                        out.append(part)
                counts.append(n)
                hashes.append(own.hexdigest())
                back.append(decoded.hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(b"".join(ids), "<u4").astype("int32"))
                    texts.append("".join(out))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<int>, decoded string" if keep_ids else ""
    return lean(source).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
