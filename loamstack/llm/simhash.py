"""Operator 3: SimHash near-deduplication with bit-sliced comparison.

Fingerprints meet in blocks. A block stores its fingerprints vertically, one
plane of bits for each fingerprint bit; the distances of a row to 64 others at a
time grow in carry-save counters of machine words, and a block is abandoned once
every counter has passed the radius.

Which fingerprints meet:

* ``links_within`` (exact, small radius): a 64-bit fingerprint is cut into
  radius + 1 parts, one of which two fingerprints within the radius share. A
  bucket that is too large is cut anew over its remaining bits, which again
  leaves the radius + 1 parts; what is still too large is compared in cells of
  two sub-blocks, so no task holds more than one cell.
* ``distinct_rows`` (by similarity): rows meet that share one of ``bands`` keys,
  each made of ``width`` minimal shingle hashes. The bit-sliced distance of their
  256-bit fingerprints (of distinct shingles) leaves out all pairs beyond
  ``RADIUS``; the whole shingle sets of all others meet in the same blocks, part
  by part, and a pair is a link if the sets are that similar. A bucket that is too
  large is first compared in sub-blocks, each with the bucket's first row; what
  these links already connect need not meet again, so a large group of similar
  texts costs in proportion to its rows, and only rows outside the bucket's largest
  group meet all others of it.

Blocks emit only a spanning forest of the links they find.

Defined cases: null text counts as empty; without words the fingerprint is zero
and is linked like any other (its set is equal to that of other such texts); a
null id is ignored in component_id unless the component has no other id, and is
the last to stay in ``distinct_rows``; repeated rows are one node, of which the
row of least id and then of the least other columns stays; very long texts are read
whole, and their sets compared in parts; an empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

import math
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_rows, lean, sieved, text_or_empty, unused, written
from loamstack.llm.components import components

#: Rows of a block at most.
BLOCK = 256
#: Shingle hashes of a part of a set, about, at most.
SET_SIZE = 4096
#: Rows of a sub-block where a large bucket's unconnected rows meet the others.
WIDE = 512
#: Bits of a fingerprint that stands for a shingle set, and how many may differ. Each bit of two sets of similarity 0.8
#: differs with probability 0.1875 at most (sets of 5 and 4 shingles), so more than 80 of 256 do in one of 1.8 million pairs.
BITS, RADIUS = 256, 80
SEED = 42
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingle_hashes(raw: bytes, words: int):
    """XXH64 of every shingle of ``words`` words, repeats included."""
    import numpy as np
    import xxhash

    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, "uint64")
    joined = b" ".join(parts)
    if len(parts) <= words:
        pieces = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        pieces = [joined[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), "uint64", len(pieces))


def mixed(hashes, k: int):
    """The k-th independent 64-bit hash made of each hash."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = (hashes ^ (np.uint64(k + 1) * np.uint64(_ODD[0]))) * np.uint64(_ODD[1 + k % 7])
        z = (z ^ (z >> np.uint64(29))) * np.uint64(_ODD[1 + (k + 3) % 7])
        return z ^ (z >> np.uint64(32))


def majority(hashes) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the hashes."""
    import numpy as np

    return int(_majorities(hashes[:, None]).view("<u8")[0])


def _majorities(hashes):
    """The bits (as bytes, least first) that are set in over half of the rows of ``hashes`` (n, words)."""
    import numpy as np

    counts = np.zeros(hashes.shape[1] * 64, "int64")
    for i in range(0, len(hashes), 1 << 13):
        rows = np.ascontiguousarray(hashes[i : i + (1 << 13)]).view("uint8")
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype="int64")
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def sketch(once) -> bytes:
    """The fingerprint of BITS bits of a set of hashes."""
    import numpy as np

    return _majorities(np.stack([mixed(once, k) for k in range(BITS // 64)], 1)).tobytes()


def _adder(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near(rows, radius: int, others=None, wanted=None):
    """Which pairs of ``rows`` (with one another, or with ``others``) differ in at most ``radius`` bits: a boolean matrix, or None if there is no pair.

    ``rows``, ``others``: (n, words) of uint64. ``wanted``: a boolean matrix of the pairs that matter; a row and itself is none.
    The block is abandoned once the distances of all pairs that matter have passed the radius.
    """
    import numpy as np

    n, width = len(rows), rows.shape[1] * 64
    m = n if others is None else len(others)
    bits = np.unpackbits(rows.view("uint8").reshape(n, -1), axis=1, bitorder="little")  # (n, width)
    across = bits if others is None else np.unpackbits(others.view("uint8").reshape(m, -1), axis=1, bitorder="little")
    lanes = -(-m // 64)

    def sliced(table):
        padded = np.zeros((len(table), lanes * 64), "uint8")
        padded[:, :m] = table
        return np.packbits(padded, axis=1, bitorder="little").view("uint64")  # (rows of table, lanes)

    planes = sliced(across.T)
    alive = np.ones((n, m), bool) if wanted is None else wanted.copy()
    if others is None:
        np.fill_diagonal(alive, False)
    alive = sliced(alive)
    flip = (bits.astype("uint64") * np.uint64(0xFFFFFFFFFFFFFFFF)).T  # (width, n)
    zero = np.zeros((n, lanes), "uint64")
    one, two, four, high = zero, zero, zero, [zero] * max(1, (width // 8).bit_length())
    past = radius // 8 + 1  # groups of eight that pass the radius
    for b in range(0, width, 8):
        x = [planes[b + i][None, :] ^ flip[b + i][:, None] for i in range(8)]
        one, t1 = _adder(one, x[0], x[1])
        one, t2 = _adder(one, x[2], x[3])
        two, f1 = _adder(two, t1, t2)
        one, t1 = _adder(one, x[4], x[5])
        one, t2 = _adder(one, x[6], x[7])
        two, f2 = _adder(two, t1, t2)
        four, carry = _adder(four, f1, f2)
        for k in range(len(high)):
            high[k], carry = high[k] ^ carry, high[k] & carry
        if b // 8 + 1 >= past and not (~_at_least(high, past) & alive).any():
            return None
    found = np.unpackbits((_at_most([one, two, four, *high], radius) & alive).view("uint8"), axis=1, bitorder="little")[:, :m].astype(bool)
    return found if found.any() else None


def _at_most(number: list, limit: int):
    """Lanes whose binary number (least bit first) is at most ``limit``."""
    import numpy as np

    less, equal = np.zeros_like(number[0]), ~np.zeros_like(number[0])
    for k in range(len(number) - 1, -1, -1):
        if limit >> k & 1:
            less, equal = less | (equal & ~number[k]), equal & number[k]
        else:
            equal = equal & ~number[k]
    return less | equal


def _at_least(number: list, limit: int):
    return ~_at_most(number, limit - 1)


def forest(adjacent) -> list[tuple[int, int]]:
    """(row, least row of its component) for rows that are not least themselves."""
    import numpy as np

    label = np.arange(len(adjacent))
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(r)) for i, r in enumerate(label) if i != r]


def _block_links(grouped: DataFrame, radius: int, node_kind: str) -> DataFrame:
    """Links found in blocks. ``grouped``: g (long, at most about 2 * BLOCK rows of each), node, fp (binary, little-endian words)."""
    columns = ["g", "node", "fp"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["a", "b"]

        def compare(nodes, fps):
            if len(nodes) < 2:
                return [], []
            found = near(np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1), radius)
            links = forest(found) if found is not None else []
            return [nodes[i] for i, _ in links], [nodes[j] for _, j in links]

        kind = None
        held: tuple[list, ...] = tuple([] for _ in columns)
        for batch in batches:
            kind = batch.schema.field("node").type
            for old, name in zip(held, columns):
                old.extend(batch.column(name).to_pylist())
            g = held[0]
            start, outs = 0, ([], [])
            while len(g) - start > 2 * BLOCK:
                # end at a change of group, so that a group is never cut
                end = start + BLOCK
                while end < len(g) and end > start and g[end] == g[end - 1]:
                    end -= 1
                if end == start:
                    end = start + BLOCK
                    while end < len(g) and g[end] == g[end - 1]:
                        end += 1
                    if end == len(g):
                        break
                a, b = compare(*(x[start:end] for x in held[1:]))
                outs[0].extend(a)
                outs[1].extend(b)
                start = end
            held = tuple(x[start:] for x in held)
            if outs[0]:
                yield pa.RecordBatch.from_arrays([pa.array(outs[0], kind), pa.array(outs[1], kind)], names=names)
        if held[0]:
            a, b = compare(*held[1:])
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=names)

    return grouped.repartition("g").sortWithinPartitions("g").select(*columns).mapInArrow(run, f"a {node_kind}, b {node_kind}")


def _cells(hot: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of buckets that are too large, dealt to cells of two sub-blocks of at most about BLOCK / 2 rows."""
    k = F.greatest(F.lit(2), F.ceil(F.col("n") / (BLOCK // 2))).cast("int")
    own = hot.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("other <> own")
    return dealt.withColumn("g", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other"))).select("g", *_carried(hot))


def _carried(rows: DataFrame) -> list[str]:
    """What a block needs of a row."""
    return [c for c in ("node", "fp", "level") if c in rows.columns]


def _blocks(rows: DataFrame, children, levels: int) -> DataFrame:
    """g, node, fp of blocks of bounded size. ``rows``: node, fp, path, key, rest; ``children(rows)`` cuts large buckets further."""
    out = None
    for level in range(levels):
        if level:
            rows = written(rows, "cut")
        large = written(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "large")
        small = rows.join(large.select("path", "key"), ["path", "key"], "left_anti").select(F.xxhash64("path", "key").alias("g"), *_carried(rows))
        out = small if out is None else out.unionByName(small)
        if large.isEmpty():
            return out
        hot = rows.join(large, ["path", "key"])
        if level == levels - 1:
            return out.unionByName(_cells(hot, ["path", "key"]))
        rows = children(hot.drop("n"), level + 1)
    raise AssertionError("levels is at least 1")


def _cut(value: Column, width: int, parts: int) -> list[tuple[Column, Column]]:
    """(part, rest) for every part of the low ``width`` bits of a long."""
    edges = [width * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(edges, edges[1:]):
        part = F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        above = F.shiftleft(F.shiftrightunsigned(value, b), a) if b < 64 else F.lit(0).cast("long")
        below = value.bitwiseAND(F.lit((1 << a) - 1)) if a else F.lit(0).cast("long")
        out.append((part.cast("long"), above.bitwiseOR(below)))
    return out


def links_within(nodes: DataFrame, radius: int = 3, levels: int = 3) -> DataFrame:
    """Spanning links (a, b) of the graph of 64-bit fingerprints within ``radius`` bits. ``nodes``: node long, distinct."""
    parts = radius + 1

    def pieces(rows: DataFrame, value: str, width: int, path: Column) -> DataFrame:
        cut = F.array(*[F.struct((path * 8 + i).alias("path"), part.alias("key"), rest.alias("rest")) for i, (part, rest) in enumerate(_cut(F.col(value), width, parts))])
        return rows.withColumn("x", F.explode(cut))

    def children(rows: DataFrame, level: int) -> DataFrame:
        # the bucket's own key goes into the path, which keeps children of different buckets apart
        width = 64
        for _ in range(level):
            width -= width // parts
        more = pieces(rows.withColumn("path", F.xxhash64("path", "key")), "rest", width, F.lit(0).cast("long"))
        return more.select("node", "fp", F.xxhash64("path", F.col("x.path")).alias("path"), F.col("x.key").alias("key"), F.col("x.rest").alias("rest"))

    fp = F.unhex(_little_hex(F.lpad(F.hex("node"), 16, "0"), 8))
    first = pieces(nodes.withColumn("fp", fp), "node", 64, F.lit(0).cast("long")).select("node", "fp", F.col("x.path").alias("path"), F.col("x.key").alias("key"), F.col("x.rest").alias("rest"))
    return _block_links(_blocks(first, children, levels), radius, "long")


def _little_hex(big: Column, size: int) -> Column:
    """Hex digits of an integer, most significant byte first, to least first."""
    return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and node: the 64-bit fingerprint of each row as a signed long."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = np.array([majority(shingle_hashes(x, shingle)) for x in binary_rows(batch, "text")], "uint64").view("int64")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "node"])

    return lean(source).mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, node long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """For each row: id_col, fingerprint (16 hex digits), component_id (the least id reachable over links of at most ``radius`` bits)."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    size = nodes.count()
    roots = components(written(links_within(nodes.select("node"), radius), "near", size))
    rooted = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", size)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = written(rooted.join(named, "root").select("node", "component_id"), "named", size)
    return rows.join(by_node, "node").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def common(sets: list, slab: int = 8192):
    """How many hashes each pair of sets (arrays of distinct hashes) shares; the diagonal is left at any value."""
    import numpy as np

    out = np.zeros((len(sets), len(sets)))
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    at, row = column[place], np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at, row = at[at >= 0], row[at >= 0]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for i in range(0, len(shared), slab):
        a, b = np.searchsorted(at, [i, i + slab])
        held = np.zeros((len(sets), min(slab, len(shared) - i)), "float32")
        held[row[a:b], at[a:b] - i] = 1
        out += held @ held.T
    return out


def _groups(batches, columns: list[str], by: int):
    """The rows of batches sorted by their first ``by`` columns: (key, lists of the other columns) for each key."""
    key, held = None, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:by] != key:
                if held:
                    yield key, [*zip(*held)]
                key, held = row[:by], []
            held.append(row[by:])
    if held:
        yield key, [*zip(*held)]


def _candidates(blocks: DataFrame) -> DataFrame:
    """g, level, node of the rows that are within RADIUS bits of another of their block.

    ``blocks``: g, node, side (0: meets rows of side 1 only where there are such, else one another), level, band, at, keys,
    powers, root, fp. Left out are pairs that an earlier band or a lower power brings together, and pairs of one root.
    """
    columns = ["g", "node", "side", "level", "band", "at", "keys", "powers", "root", "fp"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["g", "level", "node"])

        found = []
        for (g,), (node, side, level, band, at, keys, powers, root, fp) in _groups(batches, columns, 1):
            sides = np.array(side)
            a = np.flatnonzero(sides == 0)
            b = np.flatnonzero(sides == 1)
            alone = not len(b)
            if len(a) + len(b) < 2 or not len(a):
                continue
            b = a if alone else b
            own, powered = np.array(keys), np.array(powers)
            wanted = np.ones((len(a), len(b)), bool)
            for k in range(band[0]):
                wanted &= own[a, k][:, None] != own[b, k][None, :]
            # both in a lower power: at is the larger of this row's two powers, and the other one is below it
            lower = powered[:, 0] < at[0]
            wanted &= ~(lower[a][:, None] & lower[b][None, :])
            _, roots = np.unique(np.array(root, "S16"), return_inverse=True)
            named = np.array([x is not None for x in root])
            wanted &= ~((roots[a][:, None] == roots[b][None, :]) & named[a][:, None] & named[b][None, :])
            if alone:
                np.fill_diagonal(wanted, False)
            if not wanted.any():
                continue
            words = np.frombuffer(b"".join(fp), "<u8").reshape(len(node), -1)
            pairs = near(words[a], RADIUS, None if alone else words[b], wanted)
            if pairs is None:
                continue
            some = {*a[pairs.any(1)].tolist(), *b[pairs.any(0)].tolist()}
            found += [(g, level[0], x) for x in {node[i] for i in some}]
            if len(found) > 10_000:
                yield out()
                found = []
        yield out()

    return blocks.repartition("g").sortWithinPartitions("g").select(*columns).mapInArrow(run, "g long, level int, node binary")


def _parts(texts: DataFrame, shingle: int) -> DataFrame:
    """g, part, node, size, set: the whole set of each text for each of its blocks ``at`` (g, level), in 2 ** level parts by the first bits of the hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["g", "part", "node", "size", "set"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

        rows, held = [], 0
        for batch in batches:
            for node, at, raw in zip(batch.column("node").to_pylist(), batch.column("at").to_pylist(), binary_rows(batch, "text")):
                once = np.unique(mixed(np.unique(shingle_hashes(raw, shingle)), 2))
                for x in at:
                    many = 1 << x["level"]
                    starts = [0] if many == 1 else np.searchsorted(once, (np.arange(many, dtype="uint64") << np.uint64(64 - x["level"]))).tolist()
                    for part, (i, j) in enumerate(zip(starts, [*starts[1:], len(once)])):
                        rows.append((x["g"], part, node, len(once), once[i:j].astype("<u8").tobytes()))
                        held += len(rows[-1][4])
                        if held > 1 << 23 or len(rows) >= 10_000:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return lean(texts).mapInArrow(run, "g long, part long, node binary, size long, set binary")


def _similar_links(parts: DataFrame, similarity: float) -> DataFrame:
    """Spanning links (a, b) of the pairs of each block whose whole sets are that similar. One part of one block is held at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

        def close():
            sizes = np.array(block[1], "float64")
            ok = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
            np.fill_diagonal(ok, False)
            links.extend((nodes[i], nodes[j]) for i, j in forest(ok))

        links, last, both, nodes, block = [], None, None, [], None
        for (g, _), (node, size, own) in _groups(batches, ["g", "part", "node", "size", "set"], 2):
            if g != last:
                if last is not None:
                    close()
                last, both, nodes, block = g, np.zeros((len(node), len(node))), node, (node, size)
                place = {x: i for i, x in enumerate(nodes)}
                if len(links) > 10_000:
                    yield out()
                    links = []
            # every node has every part of its block
            at = np.array([place[x] for x in node])
            both[np.ix_(at, at)] += common([np.frombuffer(x, "<u8") for x in own])
        if last is not None:
            close()
        yield out()

    return parts.repartition("g").sortWithinPartitions("g", "part").mapInArrow(run, "a binary, b binary")


def _linked(blocks: DataFrame, rows: DataFrame, text: str, node: str, shingle: int, similarity: float) -> DataFrame:
    """Links of the blocks: candidates by fingerprint, then their whole sets, made anew from one text of each node."""
    some = written(_candidates(blocks), "candidates")
    wanted = written(some.groupBy("node").agg(F.collect_list(F.struct("g", "level")).alias("at")), "wanted")
    texts = rows.select(F.col(node).alias("node"), text_or_empty(text).alias("text"))
    texts = sieved(texts, [F.col("node")], wanted, [F.col("node")], "maybe").where("maybe")
    # one text stands for each node, chosen before the shuffle: a large group of copies sends one text from each task
    one = texts.groupBy("node").agg(F.first("text").alias("text"))
    return written(_similar_links(_parts(one.join(wanted, "node"), shingle), similarity), "near")


def _crossing(hot: DataFrame, roots: DataFrame, band: list[str]) -> DataFrame:
    """Blocks in which the rows outside the largest group of a large bucket meet all its rows; ``roots``: node, root of the links so far."""
    rooted = written(hot.join(roots.withColumnRenamed("root", "r"), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r"), "rooted")
    sizes = rooted.groupBy(*band, "root").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy(*band).agg(F.max(F.struct("size", "root")).alias("top")).select(*band, F.col("top.root").alias("largest"), F.col("top.size").alias("most"))
    k = lambda x: F.greatest(F.lit(1), F.ceil(x / WIDE)).cast("int")
    met = rooted.join(written(top, "top"), band).where("most < n").withColumn("k0", k(F.col("n") - F.col("most"))).withColumn("k1", k(F.col("n")))
    own = F.xxhash64("node")
    inner = met.where("root <> largest").withColumn("i", F.pmod(own, F.col("k0")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k1") - 1))).withColumn("side", F.lit(0))
    every = met.withColumn("j", F.pmod(own, F.col("k1")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k0") - 1))).withColumn("side", F.lit(1))
    return inner.unionByName(every).withColumn("g", F.xxhash64(*band, "i", "j"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 8, width: int = 2) -> DataFrame:
    """The rows of ``docs``, with one row of each group of similar texts: the one of least id (null ids last).

    Similar: a Jaccard similarity of ``similarity`` or more over the sets of word shingles. Rows of equal sets are one
    node. Two nodes meet if they share one of ``bands`` keys of ``width`` minimal shingle hashes, whatever the size of
    that bucket (at similarity 0.8 one pair of 3500 shares none); their fingerprints are compared bit-sliced, and pairs within RADIUS by
    their whole sets.
    """
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity is from 0.5 to 1")
    row, node, keys, size, fp, least = unused(docs, "near_row", "near_node", "near_keys", "near_size", "near_fp", "near_least")

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            nodes, own_keys, sizes, fps = [], [], [], []
            for raw in binary_rows(batch, text_col):
                once = np.unique(shingle_hashes(raw, shingle))
                nodes.append(hashlib.blake2b(once.astype("<u8").tobytes(), digest_size=16).digest())
                own_keys.append(_keys(once, bands, width))
                sizes.append(len(once))
                fps.append(sketch(once) if len(once) else bytes(BITS // 8))
            made = [pa.array(nodes, pa.binary()), pa.array(own_keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, node, keys, size, fp])

    kind = StructType([*docs.schema.fields, StructField(node, BinaryType()), StructField(keys, ArrayType(LongType())), StructField(size, LongType()), StructField(fp, BinaryType())])
    rows = written(lean(docs).mapInArrow(run, kind).withColumn(row, F.monotonically_increasing_id()), "rows")
    nodes = rows.groupBy(F.col(node).alias("node")).agg(F.first(F.struct(F.col(keys).alias("keys"), F.col(size).alias("size"), F.col(fp).alias("fp"))).alias("x"))
    # sets of that similarity have sizes within it, and so a power of two below both or below the larger and the smaller over it
    power = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1)) + F.lit(0.5))).cast("int")
    nodes = written(nodes.select("node", "x.keys", F.array(power(F.col("x.size")), power(F.ceil(F.col("x.size") / F.lit(similarity)))).alias("powers"), "x.fp"), "nodes")
    placed = nodes.withColumn("at", F.explode(F.array_distinct("powers"))).select("*", F.posexplode("keys").alias("band", "key"))
    placed = placed.withColumn("level", F.greatest(F.col("at") + 1 - int(math.log2(SET_SIZE)), F.lit(0)))
    bucket = ["band", "key", "at"]
    buckets = written(placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1"), "buckets")
    # rows that are alone in their bucket, most of all, do not travel
    shared = sieved(placed, [F.col(c) for c in bucket], buckets, [F.col(c) for c in bucket], "maybe").where("maybe").drop("maybe")
    met = written(shared.join(buckets, bucket).withColumn("root", F.lit(None).cast("binary")).withColumn("side", F.lit(0)), "met")
    hot = met.where(F.col("n") > BLOCK)
    # sub-blocks of a large bucket, its first row in each
    blocks = met.where(F.col("n") <= BLOCK).withColumn("g", F.xxhash64(*bucket))
    some_hot = not hot.isEmpty()
    if some_hot:
        k = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
        part = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), k - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), k).cast("int")))
        blocks = blocks.unionByName(hot.withColumn("part", F.explode(part)).withColumn("g", F.xxhash64(*bucket, "part")).drop("part"))
    links = _linked(blocks, rows, text_col, node, shingle, similarity)
    roots = components(links)
    if some_hot:
        more = _linked(_crossing(hot, roots, bucket), rows, text_col, node, shingle, similarity)
        roots = components(written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "near"))
    # ties of one id by the other columns, so that the row that stays is the same on every run
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    content = F.xxhash64(F.col(text_col), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), content.alias("h"), F.col(row).alias("r"))
    grouped = written(rows.select(F.col(row).alias("row"), order.alias("at"), F.col(node).alias("node")).join(roots, "node", "left").select("row", "at", F.coalesce("root", "node").alias("root")), "grouped")
    stays = written(grouped.groupBy("root").agg(F.min("at").alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("stay.r").alias("stay")), "stays")
    leave = written(grouped.join(stays, "root").where("stay <> row").select(F.col("row").alias(least)), "leave")
    # rows that surely stay do not travel
    split = sieved(rows.select(*docs.columns, row), [F.col(row)], leave, [F.col(least)], size)
    return split.where(~F.col(size)).select(*docs.columns).unionByName(split.where(F.col(size)).join(leave, F.col(row) == F.col(least), "left_anti").select(*docs.columns))


def _keys(once, bands: int, width: int) -> list[int]:
    """The keys of a set of hashes by which it meets others."""
    import numpy as np

    if not len(once):
        return [0] * bands
    own = np.array([mixed(once, k + 8).min() for k in range(bands * width)]).reshape(bands, width)
    out = own[:, 0]
    for j in range(1, width):
        out = mixed(out, 1) ^ own[:, j]
    return out.view("int64").tolist()
