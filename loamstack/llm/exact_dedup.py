"""Operator 7: exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``chunk_bytes``. A chunk's hash is the value of its
bytes as a polynomial in ``BASE`` under two primes below 2**31; hashes of
neighbouring chunks combine by length-shifted arithmetic,

    H(a + b) = H(a) * BASE**len(b) + H(b)   (mod p),

so chunks of a huge document can be hashed anywhere and in any grouping: those
of a document over ``HUGE`` bytes are dealt to all tasks by ``fingerprint_chunks``
and only their hashes meet. Documents of one length and fingerprint are then
compared with the group's representative chunk by chunk; those that differ form
their own groups in a further round, so the result is exact whatever the hash
does. Texts of groups with two or more members travel, as chunks of bounded
size, and few others do: a bitmap of the wanted rows (``sieved``) leaves the rest
where they lie as long as the wanted rows are few enough for it. A large group's
chunks are spread over one salt for every ``ROWS_PER_SALT`` members.

Defined cases: null text counts as empty, and all such rows are one group; a
null id is an id that sorts below all others; rows with equal id and text are
repeats, of which one is kept (``exact_rows`` keeps the least by its other
columns); very long texts are met in chunks; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import binary_column, lean, sieved, text_or_empty, unused, written

#: Base and the two primes of the fingerprint.
BASE, PRIMES = 1_000_003, (2_147_483_647, 2_147_483_629)
CHUNK_BYTES = 1 << 16
ROWS_PER_SALT = 256
#: Longer texts are hashed chunk by chunk in many tasks.
HUGE = 1 << 20


class Polynomial:
    """Chunk hashes under some primes and their combination."""

    def __init__(self, primes: tuple[int, ...] = PRIMES, chunk_bytes: int = CHUNK_BYTES):
        import numpy as np

        self.primes, self.chunk_bytes, self.powers = primes, chunk_bytes, []
        for p in primes:
            powers = np.ones(1, "uint64")
            while len(powers) < chunk_bytes:
                powers = np.concatenate([powers, powers * np.uint64(pow(BASE, len(powers), p)) % np.uint64(p)])
            self.powers.append(powers[:chunk_bytes][::-1].copy())

    def chunk(self, data) -> tuple[int, ...]:
        """Hashes of one chunk, given as an array of bytes; at most 2**16 terms of under 2**40 fit a 64-bit sum."""
        wide = data.astype("uint64") + 1
        return tuple(int((wide * w[len(w) - len(data) :]).sum() % p) for w, p in zip(self.powers, self.primes))

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_len: int) -> tuple[int, ...]:
        return tuple((a * pow(BASE, right_len, p) + b) % p for a, b, p in zip(left, right, self.primes))

    def text(self, raw: bytes) -> tuple[int, ...]:
        import numpy as np

        data, n = np.frombuffer(raw, "uint8"), self.chunk_bytes
        parts = [(self.chunk(data[i : i + n]), len(data[i : i + n])) for i in range(0, len(data), n)]
        return reduce(lambda x, y: (self.combine(x[0], y[0], y[1]), 0), parts, ((0,) * len(self.primes), 0))[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, ...] = PRIMES, chunk_bytes: int = CHUNK_BYTES, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, fp (the hashes joined by ':') and text_sha256 of every row; rows of texts over ``huge`` bytes are hashed by chunks."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        poly = Polynomial(primes, chunk_bytes)
        for batch in batches:
            texts = binary_column(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([":".join(map(str, poly.text(x))) if len(x) <= huge else None for x in texts], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                ],
                names=["doc_id", "n_bytes", "fp", "text_sha256"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = written(lean(source).mapInArrow(run, f"doc_id {kind}, n_bytes long, fp string, text_sha256 string"), "fingerprints")
    open_ = rows.where("fp IS NULL").select("text_sha256").distinct()
    if open_.isEmpty():
        return rows
    # one of each id and text: a repeated row has the same chunks
    whole = source.where(F.octet_length("text") > huge).select(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).alias("doc_id"), F.col("text").cast("binary").alias("data"))
    parts = _chunks(whole, chunk_bytes).repartition("doc_id", "chunk_no").dropDuplicates(["doc_id", "chunk_no"])
    done = written(fingerprint_chunks(parts, primes, chunk_bytes).select(F.col("doc_id.doc_id").alias("i"), F.col("doc_id.sha").alias("s"), F.col("fp").alias("whole_fp")), "huge")
    met = rows.join(done, F.col("fp").isNull() & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("s")), "left")
    return written(met.select("doc_id", "n_bytes", F.coalesce("fp", "whole_fp").alias("fp"), "text_sha256"), "fingerprints")


def fingerprint_chunks(chunks: DataFrame, primes: tuple[int, ...] = PRIMES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Fingerprints of documents stored as chunk rows (doc_id, chunk_no, data binary of at most ``chunk_bytes``).

    Every chunk is hashed where it lies; only hashes meet, and combine in the order of chunk_no.
    """
    p, q = primes

    def run(batches):
        import numpy as np
        import pyarrow as pa

        poly = Polynomial(primes, chunk_bytes)
        for batch in batches:
            data = [np.frombuffer(x or b"", "uint8") for x in batch.column("data").to_pylist()]
            hashes = [poly.chunk(x) for x in data]
            columns = [[len(x) for x in data], *zip(*hashes), *([pow(BASE, len(x), m) for x in data] for m in primes)] if data else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk_no"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "chunk_no", "n", "h1", "h2", "s1", "s2"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    hashed = chunks.select("doc_id", F.col("chunk_no").cast("long"), "data").mapInArrow(run, f"doc_id {kind}, chunk_no long, n long, h1 long, h2 long, s1 long, s2 long")
    parts = hashed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "n", "h1", "h2", "s1", "s2"))).alias("parts"))
    folded = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), ((acc["a"] * x["s1"] + x["h1"]) % p).alias("a"), ((acc["b"] * x["s2"] + x["h2"]) % q).alias("b")),
    )
    return parts.select("doc_id", folded.alias("f")).select("doc_id", F.col("f.n").alias("n_bytes"), F.concat_ws(":", "f.a", "f.b").alias("fp"))


def _chunks(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row for each chunk of a text; an empty text has one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.length("data") - 1) / chunk_bytes)).cast("int")
    exploded = texts.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return exploded.withColumn("data", F.substring("data", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))


def equal_groups(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Verified groups of two or more rows: doc_id, text_sha256, keep_id, keep_sha, group_size of each distinct member.

    ``found``: a written table of ``fingerprints``. (doc_id, text_sha256) only locates a row; equality is decided by comparing bytes.
    """
    key, at = ["n_bytes", "fp"], ["doc_id", "text_sha256"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("text_sha256"), text_or_empty(text_col).cast("binary").alias("data"))
    pool, done = found.groupBy(*key, *at).agg(F.count(F.lit(1)).alias("copies")), None
    while True:
        pool = written(pool, "pool")
        groups = written(
            pool.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("group_size"), F.max(F.struct(*at)).alias("keep"))
            .where("group_size > 1")
            .select(*key, "members", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_sha256").alias("keep_sha")),
            "groups",
        )
        members = written(pool.join(groups, key).withColumn("salts", F.ceil(F.col("members") / ROWS_PER_SALT).cast("int")), "members")
        compared = members.where("members > 1")
        if compared.isEmpty():
            round_ok = members
            differ = None
        else:
            # texts of compared rows only; repeats of a row bring one copy
            near = sieved(texts, [F.col("doc_id"), F.col("text_sha256")], compared, [F.col("doc_id"), F.col("text_sha256")], "wanted").where("wanted").drop("wanted")
            here = near.alias("t").join(compared.alias("m"), F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.text_sha256") == F.col("m.text_sha256")))
            here = here.select("m.*", "t.data")
            is_keep = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha"))
            parts = written(_chunks(here.withColumn("is_keep", is_keep), chunk_bytes), "chunks")
            model = parts.where("is_keep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*key, "salt", "chunk_no", F.col("data").alias("model"))
            other = parts.where("NOT is_keep").withColumn("salt", F.pmod(F.xxhash64(*at), F.col("salts")).cast("int"))
            differ = written(
                other.join(model, [*key, "salt", "chunk_no"], "left").where("NOT (data <=> model)").select(*key, *at, "copies").distinct(),
                "differ",
            )
            if differ.isEmpty():
                differ = None
            round_ok = members if differ is None else members.join(differ.select(*key, *at).withColumn("_d", F.lit(1)), [*key, "text_sha256"], "left_anti")
        if differ is not None:
            sizes = round_ok.groupBy(*key).agg(F.sum("copies").alias("group_size"))
            round_ok = round_ok.drop("group_size").join(sizes, key)
        round_ok = round_ok.select(*at, "copies", "keep_id", "keep_sha", "group_size")
        done = round_ok if done is None else done.unionByName(round_ok)
        if differ is None:
            return done
        pool = differ


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, ...] = PRIMES, chunk_bytes: int = CHUNK_BYTES, huge: int = HUGE) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    found = fingerprints(docs, id_col, text_col, primes, chunk_bytes, huge)
    groups = equal_groups(docs, found, id_col, text_col, chunk_bytes)
    rows = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    g = groups.select(F.col("doc_id").alias("g_id"), F.col("text_sha256").alias("g_sha"), "keep_id", "keep_sha", "group_size")
    joined = rows.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    first = F.col("g_sha").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha")))
    named = joined.select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("g_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        first.alias("first"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    )
    return named.select(id_col, "keep_id", "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def exact_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the row with the largest id; of repeats of that row the least by its other columns."""
    verdict = written(exact_duplicates(docs, id_col, text_col), "verdict")
    sha, n, maybe, own_id, own_sha, stays = unused(docs, "exact_sha", "exact_n", "exact_maybe", "exact_own_id", "exact_own_sha", "exact_stays")
    by = verdict.groupBy(F.col(id_col).alias(own_id), F.col("text_sha256").alias(own_sha)).agg(F.count(F.lit(1)).alias(n), F.max("kept").alias(stays))
    # rows that go, and rows that stay but are there more than once
    special = written(by.where(~F.col(stays) | (F.col(n) > 1)), "special")
    keyed = docs.withColumn(sha, F.sha2(text_or_empty(text_col).cast("binary"), 256))
    split = sieved(keyed, [F.col(id_col), F.col(sha)], special, [F.col(own_id), F.col(own_sha)], maybe)
    plain = split.where(~F.col(maybe)).select(*docs.columns)
    met = split.where(F.col(maybe)).join(special, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(own_sha)), "left")
    touched = written(met.where(F.col(stays).isNull() | F.col(stays)).withColumn(n, F.coalesce(n, F.lit(1))).select(*docs.columns, sha, n), "touched")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    least = touched.where(F.col(n) > 1).groupBy(id_col, sha).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*rest)) if rest else F.lit("")).alias(maybe)).select(f"{maybe}.*")
    return plain.unionByName(touched.where(F.col(n) == 1).select(*docs.columns)).unionByName(least.select(*docs.columns))
