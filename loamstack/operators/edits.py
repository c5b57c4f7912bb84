"""Edit plans: validation, preconditions against the current files, prospective links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstack.functions.markdown import page_id, safe_edit_path, targets
from loamstack.model import PLAN_FILE_BYTES, PLAN_FILES, PLAN_RATIONALE, PLAN_REFS


def validated(plans: DataFrame) -> DataFrame:
    """``failure`` (null: valid) and ``paths`` (sorted) for plans (plan_id, plan_schema, schema_digest, wanted_ref, source_refs, rationale, edits array<struct<path, content>>).

    The first rule that fails names the failure.
    """
    paths = F.transform("edits", lambda e: F.trim(e["path"]))
    refs = F.size("source_refs")
    failure = (
        F.when((F.coalesce(F.trim("schema_digest"), F.lit("")) == "") | ~F.col("plan_schema").eqNullSafe(F.col("schema_digest")), "schema_mismatch")
        .when(F.size("edits") > PLAN_FILES, "too_many_files")
        .when((refs <= 0) | (refs > PLAN_REFS), "source_refs")
        .when(F.octet_length(F.coalesce("rationale", F.lit(""))) > PLAN_RATIONALE, "rationale")
        .when(~F.exists("source_refs", lambda r: F.trim(r) == F.col("wanted_ref")), "source_not_cited")
        .when(F.exists("edits", lambda e: ~safe_edit_path(e["path"])), "forbidden_path")
        .when(F.size(F.array_distinct(paths)) < F.size(paths), "duplicate_path")
        .when(F.exists("edits", lambda e: F.octet_length(e["content"]) > PLAN_FILE_BYTES), "file_too_large")
    )
    return plans.select("plan_id", failure.alias("failure"), F.array_sort(paths).alias("paths"))


def preconditions(edits: DataFrame, files: DataFrame) -> DataFrame:
    """outcome of each edit (path, expected_digest): ok, create, missing_precondition, unexpected_precondition or stale."""
    joined = edits.join(files.select("path", F.col("digest").alias("current")), "path", "left")
    given = F.coalesce(F.col("expected_digest"), F.lit("")) != ""
    outcome = (
        F.when(F.col("current").isNull() & ~given, "create")
        .when(F.col("current").isNull(), "unexpected_precondition")
        .when(~given, "missing_precondition")
        .when(F.lower("expected_digest") == F.col("current"), "ok")
        .otherwise("stale")
    )
    return joined.withColumn("outcome", outcome)


def prospective_broken(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, target: links of the edits (path, content) to pages that neither exist nor are edited."""
    edited = edits.select(page_id(F.col("path")).alias("page_id"), "content").where("page_id IS NOT NULL")
    known = pages.select("page_id").unionByName(edited.select("page_id")).distinct()
    cited = edited.select("page_id", F.explode(F.array_distinct(targets(F.col("content")))).alias("target"))
    return cited.join(known.select(F.col("page_id").alias("target")), "target", "left_anti").select("page_id", "target")


PLAN = "schema_digest string, source_refs array<string>, rationale string, edits array<struct<path:string,expected_digest:string,content:string>>"
OUTPUT_BYTES = 1 << 20


def decoded_plans(events: DataFrame, output_bytes: int = OUTPUT_BYTES) -> DataFrame:
    """run, failure, plan of a model process's output lines (run, line_no, line): the last line that is a plan wins.

    A line is a plan if it is exactly one JSON object whose known keys have their kinds; other keys are left out. Failures:
    ``oversized`` (a run's lines have more bytes than ``output_bytes``), ``empty`` (no output), ``malformed`` (no line is a plan). They never hold output.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    # as an array of one: what stands behind a value breaks it, a second value is its second element
    one = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    whole = one.isNotNull() & F.try_variant_get(one, "$[1]", "variant").isNull() & line.rlike(r"^\s*\{")
    read = F.from_json(line, f"{PLAN}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = events.select("run", "line_no", F.octet_length(line).alias("n"), F.when(whole, read).alias("p"))
    good = F.col("p").isNotNull() & F.col("p._broken").isNull()
    plan = F.struct(*[F.col(f"p.{x.split()[0]}") for x in PLAN.split(", ")])
    found = rows.groupBy("run").agg(F.sum("n").alias("bytes"), F.max_by(F.when(good, plan), F.when(good, F.col("line_no"))).alias("plan"))
    failure = F.when(F.col("bytes") > output_bytes, "oversized").when(F.col("bytes") == 0, "empty").when(F.col("plan").isNull(), "malformed")
    return found.select("run", failure.alias("failure"), F.when(failure.isNull(), F.col("plan")).alias("plan"))


def prospective_findings(edits: DataFrame, pages: DataFrame, raw_refs: DataFrame) -> DataFrame:
    """Findings on the pages as they will be: rules of a page over the edited ones, links over current and edited together.

    ``edits``: path, content; ``pages``: page_id; ``raw_refs``: ref. The first finding in order rejects the plan.
    """
    from loamstack.operators import lint

    edited = edits.select(page_id(F.col("path")).alias("page_id"), "path", F.col("content").alias("body")).where("page_id IS NOT NULL")
    found = lint.page_findings(edited, lint.parsed(edited), raw_refs)
    lost = prospective_broken(edits, pages)
    links = lost.select(F.lit("link.broken").alias("code"), F.lit(lint.ERROR).alias("severity"), F.lit(None).cast("string").alias("path"), "page_id", F.lit(lint.MESSAGES["link.broken"]).alias("message"), F.array("target").alias("refs"))
    return lint.ordered(found.unionByName(links))
