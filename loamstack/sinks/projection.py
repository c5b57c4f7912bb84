"""The projection of a workspace: pages, links, the index and one state row for each scope.

A rebuild replaces a scope's rows in every table; a commit advances them by the pages that it changed. Either is part of one
transaction of the ledger. The snapshot's digest is a sum over rows, so that a commit subtracts the old rows and adds the new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.identity import changed_hash, multiset_hash, row_hash
from loamstack.functions.markdown import wiki_links
from loamstack.model import LINKS, PAGES, STATE, require_scope
from loamstack.operators import index as I
from loamstack.operators import refcounts as R
from loamstack.sinks.ledger import MANY_SEGMENTS, Ledger, Snapshot, Transaction

#: Tables of the projection, their schemas and what orders their rows in files, so that a filter skips row groups.
TABLES = {
    "pages": (PAGES, ["scope", "page_id"]),
    "links": (LINKS, ["scope", "from_page"]),
    "postings": (I.BLOCKS, ["scope", "term"]),
    "extent": (I.EXTENT, []),
    "voids": (I.VOIDS, []),
    "gone": (I.GONE, []),
    "counts": (R.COUNTS, ["scope", "page_id"]),
    "state": (STATE, []),
}


def page_hash():
    """Hash of a page row with its time: a touched file is another snapshot."""
    return row_hash(F.lit("page"), F.col("page_id"), F.col("path"), F.col("digest"), F.col("title"), F.array_sort("source_refs"), F.unix_micros("updated_at"))


def snapshot_digest(pages: DataFrame, links: DataFrame) -> DataFrame:
    """scope, snapshot_digest, page_count, link_count; the digest doesn't depend on the order of rows."""
    p = pages.select("scope", page_hash().alias("h"), F.lit(1).alias("p"), F.lit(0).alias("l"))
    e = links.select("scope", row_hash(F.lit("link"), F.col("from_page"), F.col("to_page"), F.col("relation")).alias("h"), F.lit(0).alias("p"), F.lit(1).alias("l"))
    both = p.unionByName(e)
    counts = both.groupBy("scope").agg(F.sum("p").cast("long").alias("page_count"), F.sum("l").cast("long").alias("link_count"))
    return multiset_hash(both, ["scope"], "h", "snapshot_digest").join(counts, "scope")


def _digest(scope: str, pages: DataFrame, links: DataFrame) -> tuple[str, int, int]:
    row = snapshot_digest(pages, links).where(F.col("scope") == scope).first()
    return (row["snapshot_digest"], row["page_count"], row["link_count"]) if row else ("", 0, 0)


def _state(scope: str, schema_digest: str, found: tuple[str, int, int], now) -> dict:
    return {"scope": scope, "schema_digest": schema_digest, "snapshot_digest": found[0], "page_count": found[1], "link_count": found[2], "ready_at": now}


def index(ledger: Ledger, at: Snapshot | None = None) -> I.Index:
    """The index as one version of the ledger has it."""
    at = at or ledger.snapshot()
    return I.Index(*[ledger.get(name, TABLES[name][0], at) for name in ("postings", "extent", "voids", "gone")])


def rebuild(ledger: Ledger, scope: str, pages: DataFrame, schema_digest: str, now, listing: DataFrame | None = None) -> dict:
    """Replace one scope's rows in every table; an empty snapshot clears the scope and is ready too. ``listing``: the index text (scope, body), if there is one."""
    require_scope(scope)
    tx = ledger.begin()
    pages = pages.where(F.col("scope") == scope).select(*PAGES.fieldNames())
    links = wiki_links(pages).select(*LINKS.fieldNames())
    state = _state(scope, schema_digest, _digest(scope, pages, links), now)
    none = {name: ledger.spark.createDataFrame([], schema) for name, (schema, _) in TABLES.items()}
    mentions = R.listed(none["pages"] if listing is None else listing)
    own = none | {"counts": R.contributions(pages, mentions), "pages": pages, "links": links, "postings": I.blocks(pages, tx.number), "extent": I.extent(pages), "state": ledger.spark.createDataFrame([tuple(state.values())], STATE)}
    for name, (schema, order) in TABLES.items():
        if name != "state" and not state["page_count"] and name not in tx.at.tables and not (name == "counts" and listing is not None):
            continue  # nothing to write, nothing to replace
        both = tx.get(name, schema).where(F.col("scope") != scope).unionByName(own[name].select(*schema.fieldNames()))
        tx.put(name, both.repartitionByRange(*order).sortWithinPartitions(*order) if order else both)
    tx.commit(note="rebuild")
    return state


def advance(tx: Transaction, scope: str, new: DataFrame, schema_digest: str, now, listing: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """Bring the projection up to pages that a commit writes (PAGES, few, each id once); all else stays as it is.

    ``listing``: the index text (scope, body) before and after, where the commit writes it.
    The rows written are those of the changed pages, whatever the size of the scope. There must be a state row.
    """
    spark = tx.ledger.spark
    tx.guard(*TABLES)
    ids = [r[0] for r in new.select("page_id").collect()]  # of a plan's files
    held = tx.get("pages", PAGES).where((F.col("scope") == scope) & F.col("page_id").isin(*ids))
    old = spark.createDataFrame(held.collect(), PAGES)  # as few, and bounded by a plan's sizes
    pages = tx.upsert("pages", new.select(*PAGES.fieldNames()).coalesce(1), ["scope", "page_id"], n=len(ids))
    links = wiki_links(pages).select(*LINKS.fieldNames())
    was = wiki_links(old).select(*LINKS.fieldNames())
    tx.upsert("links", links.coalesce(1), ["scope", "from_page"], pages.select("scope", F.col("page_id").alias("from_page")), n=len(ids))
    tx.append("postings", I.blocks(pages, tx.number).coalesce(1).sortWithinPartitions("scope", "term"), n=len(ids))
    gone = I.extent(old).select("scope", (-F.col("pages")).alias("pages"), (-F.col("tokens")).alias("tokens"))
    tx.append("extent", I.extent(pages).unionByName(gone).coalesce(1))
    if old.count():
        tx.append("voids", old.select("scope", "page_id", F.lit(tx.number).cast("long").alias("before")).coalesce(1), n=len(ids))
        tx.append("gone", I.term_counts(old).coalesce(1), n=len(ids))
    none = old.limit(0).select("scope", "body")
    left, joined = listing or (none, none)
    delta = R.contributions(pages, R.listed(joined)).unionByName(R.contributions(old, R.listed(left), -1))
    tx.append("counts", R.summed(delta).coalesce(1), n=len(ids))
    before = tx.get("state", STATE).where(F.col("scope") == scope).first()
    added, removed = _digest(scope, pages, links), _digest(scope, old, was)
    now_is = changed_hash(before["snapshot_digest"], added[0], removed[0]), before["page_count"] + added[1] - removed[1], before["link_count"] + added[2] - removed[2]
    state = _state(scope, schema_digest, now_is, now)
    tx.upsert("state", spark.createDataFrame([tuple(state.values())], STATE).coalesce(1), ["scope"])
    return state


def tidy(ledger: Ledger) -> list[str]:
    """Merge the segments of tables that have many; the counts are summed."""
    tx = ledger.begin()
    if len(tx.at.tables.get("counts", [])) > MANY_SEGMENTS:
        tx.put("counts", R.summed(tx.get("counts", R.COUNTS)).repartitionByRange("scope", "page_id").sortWithinPartitions("scope", "page_id"))
        tx.commit(note="counts")
        return ["counts", *tidy(ledger)]
    return [name for name, (schema, _) in TABLES.items() if ledger.compact(name, schema)]


def is_current(ledger: Ledger, scope: str, pages: DataFrame, schema_digest: str) -> bool:
    """Whether the state row is that of these pages and this schema."""
    state = ledger.get("state", STATE).where(F.col("scope") == scope).first()
    if state and state["page_count"] and not (ledger.generation("counts") and ledger.generation("postings")):  # written before there were these
        return False
    return state is not None and state["schema_digest"] == schema_digest and state["snapshot_digest"] == _digest(scope, pages, wiki_links(pages))[0]


def ensure(ledger: Ledger, scope: str, pages: DataFrame, schema_digest: str, now, listing: DataFrame | None = None) -> bool:
    """Check, rebuild if it drifted, check again."""
    if not is_current(ledger, scope, pages, schema_digest):
        rebuild(ledger, scope, pages, schema_digest, now, listing)
    return is_current(ledger, scope, pages, schema_digest)
