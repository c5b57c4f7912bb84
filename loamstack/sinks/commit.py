"""Commit of validated edits to the canonical pages, with an append-only log: one transaction of the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.identity import digest
from loamstack.functions.markdown import page_id
from loamstack.model import struct
from loamstack.operators.edits import preconditions, prospective_broken, prospective_findings
from loamstack.sinks.ledger import Ledger, Snapshot, Transaction

FILES = "path string, digest string, content string"
LOG = "ordinal long, operation_id string, generation string, schema_digest string, source_refs array<string>, files array<string>"


class StaleEdit(RuntimeError):
    """A target changed since the plan was made."""


class BrokenPlan(RuntimeError):
    """An edit would leave a page that breaks a rule, or a broken link."""


def generation(edits: DataFrame, operation: str, schema_digest: str) -> str:
    """The name of a commit: a hash over the operation, the schema and the edits, whatever their order."""
    rows = edits.select(F.to_json(F.struct("path", digest(F.col("content").cast("binary")).alias("digest"))).alias("e"))
    return rows.agg(F.sha2(F.concat_ws("\n", F.lit(operation), F.lit(schema_digest), F.array_join(F.sort_array(F.collect_list("e")), "\n")), 256)).first()[0]


def _checked(edits: DataFrame, files: DataFrame, known_refs: DataFrame | None) -> None:
    """Raise unless the edits fit the files as they are and the pages will be sound; with ``known_refs`` (ref) the rules of a page count too."""
    bad = preconditions(edits, files).where("outcome NOT IN ('ok', 'create')").limit(1).collect()
    if bad:
        raise StaleEdit(f"{bad[0]['path']}: {bad[0]['outcome']}")
    known = files.select(page_id(F.col("path")).alias("page_id")).where("page_id IS NOT NULL")
    if known_refs is None:
        if prospective_broken(edits, known).limit(1).count():
            raise BrokenPlan("an edit links to a page that won't exist")
        return
    found = prospective_findings(edits.select("path", "content"), known, known_refs).where("severity = 'error'").limit(1).collect()
    if found:
        raise BrokenPlan(f"{found[0]['page_id']}: {found[0]['code']}")


def commit(
    ledger: Ledger, edits: DataFrame, operation: str, schema_digest: str, refs: list[str], known_refs: DataFrame | None = None,
    beside: Callable[[Transaction, DataFrame, int, str], None] = lambda tx, files, ordinal, name: None, check: Callable[[Snapshot], None] = lambda newest: None,
) -> str:
    """Apply edits (path, expected_digest, content); a replay of the same commit changes nothing. The changed files and one log entry are written.

    ``beside`` may add to the transaction: it gets the files, the entry's ordinal and the generation. ``check`` may refuse the version that the commit would follow.
    """
    name = generation(edits, operation, schema_digest)
    tx = ledger.begin()
    files, log = tx.get("files", struct(FILES)), tx.get("log", struct(LOG))
    if log.where(F.col("generation") == name).limit(1).count():
        return name
    _checked(edits, files, known_refs)
    tx.guard("files", "log")
    new = tx.upsert("files", edits.select("path", digest(F.col("content").cast("binary")).alias("digest"), "content").coalesce(1), ["path"])
    n = log.agg(F.coalesce(F.max("ordinal"), F.lit(0))).first()[0] + 1
    paths = sorted(r[0] for r in new.select("path").collect())  # of a plan
    tx.append("log", edits.sparkSession.createDataFrame([(n, operation, name, schema_digest, sorted(refs), paths)], LOG).coalesce(1))
    beside(tx, new, n, name)
    tx.commit(check, operation=operation, generation=name)
    return name


def log_lines(log: DataFrame) -> DataFrame:
    """line_no, line: the log as Markdown list lines of JSON records, a row each."""
    return log.select(F.col("ordinal").alias("line_no"), F.concat(F.lit("- "), F.to_json(F.struct("operation_id", "generation", "schema_digest", "source_refs", "files"))).alias("line"))


def write_log(log: DataFrame, folder: str) -> None:
    """The log as text files whose concatenation in order of their names is the log: its heading, then the lines in parts by range."""
    from loamstack.sinks.text import write_ordered

    write_ordered(log_lines(log), ["line_no"], "line", folder, heading="# Log\n")


STAGE = "operation_id string, generation string, schema_digest string, source_refs array<string>, path string, expected_digest string, digest string, content string"


class BrokenStage(RuntimeError):
    """A stage that isn't what was staged."""


def stage(ledger: Ledger, edits: DataFrame, operation: str, schema_digest: str, refs: list[str], known_refs: DataFrame | None = None) -> str:
    """Keep validated edits for review; the same plan staged again changes nothing. Returns the generation that a commit will have."""
    name = generation(edits, operation, schema_digest)
    stages = ledger.get("stages", struct(STAGE))
    if stages.where((F.col("operation_id") == operation) & (F.col("generation") == name)).limit(1).count():
        return name
    _checked(edits, ledger.get("files", struct(FILES)), known_refs)
    rows = edits.select(
        F.lit(operation).alias("operation_id"), F.lit(name).alias("generation"), F.lit(schema_digest).alias("schema_digest"), F.array(*[F.lit(r) for r in sorted(refs)]).cast("array<string>").alias("source_refs"),
        "path", "expected_digest", digest(F.col("content").cast("binary")).alias("digest"), "content",
    )
    tx = ledger.begin()
    tx.upsert("stages", rows.coalesce(1), ["operation_id"])
    tx.commit(staged=operation)
    return name


def load_stage(ledger: Ledger, operation: str, schema_digest: str) -> DataFrame | None:
    """The staged edits of an operation, verified; None if there are none. A changed schema or content is refused."""
    rows = ledger.get("stages", struct(STAGE)).where(F.col("operation_id") == operation)
    first = rows.select("generation", "schema_digest").first()
    if first is None:
        return None
    edits = rows.select("path", "expected_digest", "content")
    wrong = rows.where((F.col("schema_digest") != schema_digest) | (digest(F.col("content").cast("binary")) != F.col("digest"))).limit(1).count()
    if wrong or generation(edits, operation, schema_digest) != first["generation"]:
        raise BrokenStage(operation)
    return edits


def staged_refs(ledger: Ledger, operation: str) -> list[str]:
    row = ledger.get("stages", struct(STAGE)).where(F.col("operation_id") == operation).select("source_refs").first()
    return list(row[0]) if row else []


def staged_generation(ledger: Ledger, operation: str) -> str | None:
    row = ledger.get("stages", struct(STAGE)).where(F.col("operation_id") == operation).select("generation").first()
    return row[0] if row else None


def discard_stages(ledger: Ledger, open_ids: DataFrame) -> None:
    """Drop the stages of operations that are not open (operation_id) any more."""
    stages = ledger.get("stages", struct(STAGE))
    if stages.join(open_ids.select("operation_id"), "operation_id", "left_anti").limit(1).count():
        ledger.put("stages", stages.join(open_ids.select("operation_id"), "operation_id", "left_semi").select(*stages.columns))
