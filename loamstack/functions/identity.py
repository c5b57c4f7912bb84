"""Digests and keys: how sources, pages, operations and generations are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions.lexical import trimmed


def digest(content: Column) -> Column:
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(content, 256)


def token(text: Column) -> Column:
    """The path token of a text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def raw_location(scope: Column, adapter: Column, source_id: Column, version: Column) -> Column:
    """Directory of an accepted source revision."""
    nul = F.lit("\0")
    return F.concat(F.lit("raw/"), token(F.concat(scope, nul, adapter, nul, source_id)), F.lit("/"), token(version))


def source_ref(adapter: Column, source_id: Column, version: Column) -> Column:
    """The citation key of a source revision."""
    return F.concat(adapter, F.lit(":"), source_id, F.lit("@"), version)


def operation_id(scope: Column, adapter: Column, source_id: Column, version: Column, found: Column) -> Column:
    return F.concat(scope, F.lit(":"), source_ref(adapter, source_id, version), F.lit("#"), F.substring(found, 1, 16))


def present(text: Column) -> Column:
    """A text that is not blank, else null."""
    clean = trimmed(F.coalesce(text, F.lit("")))
    return F.when(clean != "", clean)


def inline_id(origin: Column, key: Column, found: Column) -> Column:
    """Id of a source given inline: its origin, else the idempotency key, else from the digest."""
    return F.coalesce(present(origin), present(key), F.concat(F.lit("source-"), F.substring(found, 1, 16)))


def inline_version(key: Column, found: Column) -> Column:
    return F.coalesce(present(key), F.concat(F.lit("sha256-"), F.substring(found, 1, 16)))


def is_digest(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("^[0-9a-fA-F]{64}$")


def failure_class(message: Column) -> Column:
    """What stands before the first colon."""
    return trimmed(F.substring_index(message, ":", 1))


def row_hash(*columns: Column) -> Column:
    """Hash of a row with nulls and arrays kept apart."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def set_hash(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``name`` for each key: a hash of its set of row hashes, whatever their order.

    Hashes meet by their first three digits first, so that no task holds all of a large key.
    """
    fold = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    parts = rows.groupBy(*keys, F.substring(column, 1, 3).alias("_part")).agg(fold(column).alias("_hash"))
    return parts.groupBy(*keys).agg(fold(F.concat("_part", "_hash")).alias(name))


#: A multiset of row hashes is told by so many sums of so many hex digits each.
LANES, LANE = 4, 15
_SIZE = 1 << 4 * LANE


def multiset_hash(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``name`` for each key: a hash of its multiset of row hashes (SHA-256 in hex), whatever their order.

    It is a sum, so that it combines before the shuffle, and a changed row is subtracted and added (``changed_hash``).
    """
    lane = lambda i: F.conv(F.substring(column, 1 + LANE * i, LANE), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*keys).agg(*[F.sum(lane(i)).alias(f"_lane{i}") for i in range(LANES)])
    shown = [F.lpad(F.lower(F.hex(F.pmod(F.col(f"_lane{i}"), F.lit(_SIZE).cast("decimal(38,0)")).cast("long"))), LANE, "0") for i in range(LANES)]
    return sums.select(*keys, F.concat(*shown).alias(name))


def changed_hash(before: str, added: str, removed: str) -> str:
    """The multiset hash after rows were added and removed; '' is the hash of no rows."""
    lanes = lambda h: [int(h[i * LANE : (i + 1) * LANE] or "0", 16) for i in range(LANES)]
    new = [(x + y - z) % _SIZE for x, y, z in zip(lanes(before), lanes(added), lanes(removed), strict=True)]
    return "".join(f"{x:0{LANE}x}" for x in new) if any(new) else ""
