"""Lint: every rule is a small query over the workspace's tables; findings are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstack.functions.lexical import trimmed
from loamstack.functions.markdown import frontmatter, index_targets, lines, targets, unclosed
from loamstack.model import LOG_RECORD

ERROR, WARNING, INFO = "error", "warning", "info"
INDEX_PATH, LOG_PATH = "wiki/index.md", "wiki/log.md"

# What findings say.
MESSAGES = {
    "raw": "raw source manifest or immutable content is invalid",
    "raw.duplicate_identity": "one source identity/version has conflicting digests",
    "page.duplicate_id": "multiple canonical pages use the same page ID",
    "frontmatter.malformed": "page frontmatter is missing or malformed",
    "frontmatter.id_missing": "page frontmatter must declare id",
    "frontmatter.id_mismatch": "frontmatter id does not match the canonical page ID",
    "frontmatter.title_missing": "page frontmatter must declare title",
    "frontmatter.type_missing": "page frontmatter must declare type",
    "citation.missing": "page must cite at least one accepted raw source",
    "citation.unknown_source": "page cites a raw source that is not present in the workspace",
    "link.malformed": "page contains an unterminated wiki link",
    "link.broken": "wiki link points to a missing page",
    "index.malformed": "index contains an unterminated wiki link",
    "index.broken_page": "index points to a page that does not exist",
    "index.missing_page": "canonical page is not listed in index",
    "page.orphan": "page has no incoming wiki link or index entry",
    "log.malformed": "log entry is not a complete structured commit record",
    "log.duplicate_operation": "log contains duplicate operation IDs",
    "log.schema_mismatch": "log entry schema digest differs from the current schema",
    "log.order": "log entry file list is not deterministic",
    "log.missing_file": "log entry cites a file absent from canonical Markdown",
    "projection.drift": "SQL/search projection is not ready or does not match canonical Markdown",
    "projection.unavailable": "configured search index does not expose projection drift checks",
    "lint.provider_unavailable": "optional maintainer lint could not read schema",
    "lint.provider_failed": "optional maintainer lint failed without changing canonical content",
    "lint.suggestion": "optional maintainer suggested a reviewable edit",
}
#: The other text of log.malformed, of a line that is no list item.
NO_LIST_ITEM = "log contains a non-structured entry"


def finding(df: DataFrame, code: str | Column, severity: str, path: Column | None = None, page: Column | None = None, refs: Column | None = None, message: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    name = F.lit(code) if isinstance(code, str) else code
    return df.select(
        name.alias("code"),
        F.lit(severity).alias("severity"),
        (none if path is None else path).alias("path"),
        (none if page is None else page).alias("page_id"),
        F.lit(message or MESSAGES[code]).alias("message"),
        (F.lit(None).cast("array<string>") if refs is None else refs).alias("refs"),
    )


def raw_findings(records: DataFrame) -> DataFrame:
    """``records``: path, ref (citation key), digest, valid, error_class."""
    invalid = records.where("NOT valid").withColumn("code", F.concat(F.lit("raw."), F.coalesce(F.nullif("error_class", F.lit("")), F.lit("manifest_invalid"))))
    order = Window.partitionBy("ref").orderBy("path")
    again = records.where("valid").withColumn("before", F.lag("digest").over(order)).where("before <> digest")
    return finding(invalid, F.col("code"), ERROR, F.col("path"), message=MESSAGES["raw"]).unionByName(finding(again, "raw.duplicate_identity", ERROR, F.col("path")))


def page_findings(pages: DataFrame, parsed: DataFrame, raw_refs: DataFrame) -> DataFrame:
    """``pages``: page_id, path, body; ``parsed``: page_id, path, meta (frontmatter); ``raw_refs``: ref of valid sources."""
    repeated = pages.withColumn("n", F.row_number().over(Window.partitionBy(*[c for c in ("scope", "page_id") if c in pages.columns]).orderBy("path"))).where("n > 1")
    at = dict(path=F.col("path"), page=F.col("page_id"))
    ok = F.col("meta.ok")
    blank = lambda name: ok & (F.coalesce(F.col(f"meta.{name}"), F.lit("")) == "")
    # the rules on one page are read off its parsed frontmatter in one pass
    own = _each(
        parsed,
        {
            "frontmatter.malformed": ~ok,
            "frontmatter.id_missing": blank("id"),
            "frontmatter.id_mismatch": ok & ~blank("id") & (F.col("meta.id") != F.col("page_id")),
            "frontmatter.title_missing": blank("title"),
            "frontmatter.type_missing": blank("type"),
            "citation.missing": ok & (F.size("meta.source_refs") == 0),
        },
        ERROR,
        **at,
    )
    cited = parsed.where(ok).select("path", "page_id", F.explode("meta.source_refs").alias("ref"))
    parts = [
        finding(repeated, "page.duplicate_id", ERROR, **at),
        own,
        finding(cited.join(raw_refs, "ref", "left_anti"), "citation.unknown_source", ERROR, refs=F.array("ref"), **at),
        finding(pages.where(unclosed(F.col("body"))), "link.malformed", ERROR, **at),
    ]
    return reduce(DataFrame.unionByName, parts)


def _each(rows: DataFrame, rules: dict[str, Column], severity: str, path: Column | None = None, page: Column | None = None) -> DataFrame:
    """A finding for every rule that holds, from one pass over the rows."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(MESSAGES[code]).alias("message"))) for code, rule in rules.items()]))
    none = F.lit(None).cast("string")
    found = rows.select((none if path is None else path).alias("path"), (none if page is None else page).alias("page_id"), F.explode(held).alias("f"))
    return found.select("f.code", F.lit(severity).alias("severity"), "path", "page_id", "f.message", F.lit(None).cast("array<string>").alias("refs"))


def link_findings(pages: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """``links``: from_page, to_page; ``index``: at most one row with body."""
    known = pages.select("page_id").distinct()
    listed = index.select(F.explode(index_targets(F.col("body"))).alias("page_id"))
    incoming = pages.select(F.explode(targets(F.col("body"))).alias("page_id"))
    index_path = F.lit(INDEX_PATH)
    missing = links.join(known.withColumnRenamed("page_id", "to_page"), "to_page", "left_anti")
    parts = [
        finding(index.where(unclosed(F.col("body"))), "index.malformed", ERROR, index_path),
        finding(listed.join(known, "page_id", "left_anti"), "index.broken_page", ERROR, index_path, F.col("page_id")),
        finding(pages.join(listed, "page_id", "left_anti"), "index.missing_page", WARNING, index_path, F.col("page_id")),
        finding(pages.join(incoming.unionByName(listed), "page_id", "left_anti"), "page.orphan", WARNING, F.col("path"), F.col("page_id")),
        finding(missing, "link.broken", ERROR, None, F.col("from_page"), F.array("to_page")),
    ]
    return reduce(DataFrame.unionByName, parts)


def log_entries(log: DataFrame) -> DataFrame:
    """line_no, listed, record, complete of the log's lines (line_no, line); blank lines and headings are skipped."""
    rows = log.withColumn("raw", trimmed(F.col("line"))).where("raw <> '' AND NOT startswith(raw, '#')")
    listed = F.col("raw").startswith("- ")
    record = F.from_json(F.when(listed, F.substring("raw", 3, 1 << 30)), LOG_RECORD)
    full = (F.coalesce(F.col("record.operation_id"), F.lit("")) != "") & (F.coalesce(F.col("record.generation"), F.lit("")) != "") & (F.coalesce(F.size("record.files"), F.lit(0)) > 0)
    return rows.select("line_no", listed.alias("listed"), record.alias("record")).withColumn("complete", F.coalesce(full, F.lit(False)))


def text_lines(text: DataFrame) -> DataFrame:
    """line_no, line of one text (body)."""
    return text.select(F.posexplode(lines(F.col("body"))).alias("line_no", "line"))


def log_findings(log: DataFrame, schema_digest: str, files: DataFrame) -> DataFrame:
    """``log``: line_no, line, in any order and any number of tasks; ``files``: path of every canonical file."""
    entries = log_entries(log)
    good, path = F.col("complete"), F.lit(LOG_PATH)
    own = _each(
        entries,
        {
            "log.malformed": ~good & F.col("listed"),
            "log.schema_mismatch": good & ~F.col("record.schema_digest").eqNullSafe(F.lit(schema_digest)),
            "log.order": good & (F.col("record.files") != F.array_sort("record.files")),
        },
        ERROR,
        path,
    )
    whole = entries.where(good).select("line_no", F.col("record.operation_id").alias("operation_id"))
    # each entry after an operation's first one; a join, since the engine splits an operation with very many
    first = whole.groupBy("operation_id").agg(F.min("line_no").alias("first"))
    again = whole.join(first, "operation_id").where("line_no > first")
    cited = entries.where(good).select(F.explode("record.files").alias("path"))
    parts = [
        own,
        finding(entries.where("NOT listed"), "log.malformed", ERROR, path, message=NO_LIST_ITEM),
        finding(again, "log.duplicate_operation", ERROR, path),
        finding(cited.join(files, "path", "left_anti"), "log.missing_file", ERROR, F.col("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def projection_finding(state: DataFrame, snapshot_digest: str) -> DataFrame:
    """A drift finding unless the one state row holds this digest."""
    ok = state.agg(F.coalesce(F.max(F.col("snapshot_digest") == snapshot_digest), F.lit(False)).alias("ok"))
    return finding(ok.where("NOT ok"), "projection.drift", ERROR)


def projection_unavailable(spark) -> DataFrame:
    """The finding of an engine whose index keeps no state to compare."""
    return finding(spark.range(1), "projection.unavailable", INFO)


def suggestions(findings: DataFrame, suggest=None) -> DataFrame:
    """Findings of an optional callable that sees the findings so far and returns the paths that it would edit.

    A callable that raises ``LookupError`` could not read the schema; any other failure is a warning of its own.
    """
    spark = findings.sparkSession
    schema = "code string, severity string, path string, page_id string, message string, refs array<string>"
    if suggest is None:
        return spark.createDataFrame([], schema)
    one = lambda code, severity, path=None: (code, severity, path, None, MESSAGES[code], None)
    try:
        rows = [one("lint.suggestion", INFO, str(x)) for x in suggest([r.asDict() for r in ordered(findings).limit(200).collect()])]
    except LookupError:
        rows = [one("lint.provider_unavailable", WARNING)]
    except Exception:  # noqa: BLE001  whatever the callable raises is one finding
        rows = [one("lint.provider_failed", WARNING)]
    return spark.createDataFrame(rows, schema)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("code", "path", "page_id", "message")


def healthy(findings: DataFrame) -> DataFrame:
    """One row: healthy, findings, errors, warnings."""
    bad = F.col("severity").isin(ERROR, WARNING)
    return findings.agg(
        (F.coalesce(F.max(bad.cast("int")), F.lit(0)) == 0).alias("healthy"),
        F.count(F.lit(1)).alias("findings"),
        F.count(F.when(F.col("severity") == ERROR, 1)).alias("errors"),
        F.count(F.when(F.col("severity") == WARNING, 1)).alias("warnings"),
    )


def parsed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "path", frontmatter(F.col("body")).alias("meta"))
