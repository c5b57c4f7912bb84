"""The facade: retrieve evidence, ingest one source, read one operation; lint, bootstrap and recovery beside them.

All tables lie in one ledger: an accepted source and its operation, or a commit with its log entry, its projection and
the operation's end, become visible together or not at all. A maintainer is any callable that takes the accepted source, the
context pages and the schema and returns an edit plan, or the output lines of a model process that hold one; it runs on
the driver and never inside a plan of Spark.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.deadline import DeadlineExceeded, deadline
from loamstack.functions.identity import raw_location, source_ref
from loamstack.functions.lexical import InvalidQuery
from loamstack.functions.markdown import frontmatter, page_id, page_title, source_title, unclosed, wiki_links
from loamstack.model import APPLY_LEASE_SECONDS, LINKS, MAX_SOURCE_BYTES, OPERATIONS, PAGES, ReadLimits, SourceConflict, require_scope, struct
from loamstack.operators import batch, evidence, graph, lint, refcounts, work
from loamstack.operators import edits as E
from loamstack.operators.search import related_terms
from loamstack.sinks import commit as C
from loamstack.sinks import projection as P
from loamstack.sinks.ledger import Ledger, Overtaken, Snapshot
from loamstack.sinks.operations import LeaseHeld, Operations

ASSETS = struct("path string, digest string, content binary")
SOURCES = struct("scope string, adapter string, source_id string, version string, digest string, media_type string, received_at timestamp, content binary")


@dataclass(frozen=True)
class Plan:
    """What a maintainer returns: edits are (path, expected digest or '', content)."""

    schema_digest: str
    source_refs: list[str]
    edits: list[tuple[str, str, str]]
    rationale: str = ""


class PlanRejected(ValueError):
    """The plan failed validation; the message is its class."""


class StageMissing(RuntimeError):
    """A planned operation whose stage is gone."""


class Cancelled(RuntimeError):
    """The run's work lease was lost; the operation is left to whoever holds it now."""


#: Ends of a run that say nothing about the operation: it stays as it is and is run again.
RETRYABLE = (Cancelled, DeadlineExceeded, LeaseHeld, Overtaken)


@dataclass
class Engine:
    spark: SparkSession
    root: str
    scope: str
    maintainer: Callable[[dict, list[dict], str], Plan | list[str]] | None = None
    schema: str = "# Schema\nversion: 1\n"
    clock: Callable[[], dt.datetime] = field(default=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def __post_init__(self):
        require_scope(self.scope)
        self.ledger = Ledger(self.spark, f"{self.root.rstrip('/')}/{hashlib.sha256(self.scope.encode()).hexdigest()[:32]}")
        self.operations = Operations(self.ledger)
        self.schema_digest = hashlib.sha256(self.schema.encode()).hexdigest()
        self.recover()

    # --- state

    def recover(self) -> None:
        """Drop what an interrupted write left behind, then bring the projection up to date."""
        self.ledger.recover()
        C.discard_stages(self.ledger, self.operations.table().where("status NOT IN ('committed', 'failed')"))
        P.ensure(self.ledger, self.scope, self.snapshot(), self.schema_digest, self.clock(), self._listing(self.files()))

    def tidy(self) -> list[str]:
        """Merge the small segments of tables that have many; their names."""
        own = {"sources": SOURCES, "operations": OPERATIONS, "stages": struct(C.STAGE), "files": struct(C.FILES), "log": struct(C.LOG)}
        return [name for name, schema in own.items() if self.ledger.compact(name, schema)] + P.tidy(self.ledger)

    def now(self):
        return F.lit(self.clock())

    def files(self) -> DataFrame:
        return self.ledger.get("files", struct(C.FILES))

    def _pages_of(self, files: DataFrame) -> DataFrame:
        """Page rows of files (path, digest, content, ordinal); the update time is that of the commit's log entry."""
        rows = files.withColumn("page_id", page_id(F.col("path"))).where("page_id IS NOT NULL").withColumn("meta", frontmatter(F.col("content")))
        return rows.select(
            F.lit(self.scope).alias("scope"), "page_id", "path", page_title(F.col("content")).alias("title"), F.col("content").alias("body"), "digest",
            F.array_sort(F.array_distinct(F.coalesce("meta.source_refs", F.array().cast("array<string>")))).alias("source_refs"), F.lit(True).alias("untrusted"),
            F.timestamp_seconds(F.coalesce("ordinal", F.lit(0))).alias("updated_at"),
        )

    def snapshot(self) -> DataFrame:
        """The canonical pages."""
        log = self.ledger.get("log", struct(C.LOG)).select("ordinal", F.explode("files").alias("path")).groupBy("path").agg(F.max("ordinal").alias("ordinal"))
        return self._pages_of(self.files().join(log, "path", "left"))

    def _listing(self, files: DataFrame) -> DataFrame:
        """scope, body of the index among files."""
        return files.where(F.col("path") == lint.INDEX_PATH).select(F.lit(self.scope).alias("scope"), F.col("content").alias("body"))

    def assets(self) -> DataFrame:
        """Imported files that are no notes, under the paths to which rewritten references point."""
        return self.ledger.get("assets", ASSETS)

    def refs(self) -> DataFrame:
        """The references of the accepted sources."""
        return self.ledger.get("sources", SOURCES).select(source_ref(F.col("adapter"), F.col("source_id"), F.col("version")).alias("ref"))

    def pages(self) -> DataFrame:
        return self.ledger.get("pages", PAGES)

    def links(self) -> DataFrame:
        return self.ledger.get("links", LINKS)

    # --- the three public operations

    def index(self):
        return P.index(self.ledger)

    def retrieve(self, question: str, limits: ReadLimits | None = None) -> evidence.Evidence:
        """Evidence from the index; no text is read but that of the hits, within the limits' seconds."""
        limits, at = limits or ReadLimits(characters=1024), self.ledger.snapshot()
        with deadline(self.spark, limits.seconds):
            return evidence.query_indexed(P.index(self.ledger, at), self.ledger.get("pages", PAGES, at), self.ledger.get("links", LINKS, at), self.scope, question, limits)

    def contexts(self, questions: DataFrame, limits: ReadLimits | None = None) -> DataFrame:
        """question, place, page_id of the context of many questions (question, terms) at once."""
        asked = questions.select("question", F.lit(self.scope).alias("scope"), "terms")
        return batch.context_pages(self.index(), self.pages(), self.links(), asked, (limits or ReadLimits()).page_limit)

    def ingest(self, adapter: str, source_id: str, version: str, content: bytes, media_type: str = "text/plain") -> str:
        """Accept a source revision and reserve its operation, both at once; returns the operation's id."""
        if not all(x.strip() for x in (adapter, source_id, version)) or not 0 < len(content) <= MAX_SOURCE_BYTES:
            raise ValueError("a source needs an identity and bounded content")
        found, now = hashlib.sha256(content).hexdigest(), self.clock()
        row = [(self.scope, adapter, source_id, version, found, media_type, now, bytearray(content))]
        source = self.spark.createDataFrame(row, SOURCES).coalesce(1)
        request = source.drop("content", "received_at").select(
            "*", F.lit(self.schema_digest).alias("schema_digest"), F.lit(self.schema.encode()).alias("schema_snapshot"), F.lit("1").alias("schema_version"), F.lit(f"raw/{found[:32]}/manifest.yaml").alias("manifest_ref")
        )
        while True:
            tx = self.ledger.begin()
            tx.guard("sources", "operations")
            same = tx.get("sources", SOURCES).where((F.col("adapter") == adapter) & (F.col("source_id") == source_id) & (F.col("version") == version)).select("digest").first()
            if same and same[0] != found:
                raise SourceConflict(f"{adapter}:{source_id}@{version}")
            new = self.operations.requested(request, tx.get("operations", OPERATIONS), F.lit(now))
            reserved = new.isEmpty()
            if not same:
                tx.append("sources", source)
            if not reserved:
                self.operations.write(tx, new)
            try:
                if not (same and reserved):
                    tx.commit(source=f"{adapter}:{source_id}@{version}")
            except Overtaken:
                continue
            return f"{self.scope}:{adapter}:{source_id}@{version}#{found[:16]}"

    def operation(self, operation: str) -> dict:
        row = work.public_operations(self.operations.table().where(F.col("scope") == self.scope)).where(F.col("operation_id") == operation).first()
        if row is None:
            raise KeyError(operation)
        return row.asDict()

    # --- work

    def claim(self, n: int) -> tuple[str, list[str]]:
        """Fail descriptors that can never run, then claim ready operations."""
        for row in work.descriptor_failures(self.operations.table(), self.scope).select("operation_id").collect():
            self.operations.move(row[0], "fail", self.now(), failure_class="descriptor")
        return self.operations.claim(self.scope, self.now(), n)

    def run_ready(self, n: int = 16) -> list[str]:
        """Claim ready operations and run each to its end."""
        token, ids = self.claim(n)
        for operation in ids:
            if self.operations.renew(operation, token, self.now()):
                self.run(operation)
        return ids

    def run(self, operation: str, held: Callable[[], bool] = lambda: True) -> str:
        """Plan and stage, or take up the stage that is there, then apply. ``held``, asked before each step, tells whether the run may go on.

        A failure ends the operation with its class; one of ``RETRYABLE`` is raised and leaves it as it is.
        """
        row = self.operations.row(operation)
        if row is None:
            raise KeyError(operation)
        if row["status"] in ("committed", "failed"):
            return row["status"]
        try:
            if row["status"] == "received":
                self._go_on(held)
                self._stage(row, held)
            return self.apply(operation, held)
        except PlanRejected:
            return self._failed(operation, "plan")
        except (C.StaleEdit, C.BrokenPlan) as error:
            return self._failed(operation, "stale" if isinstance(error, C.StaleEdit) else "content")
        except StageMissing:
            return self._failed(operation, "staging")

    def _go_on(self, held: Callable[[], bool]) -> None:
        if not held():
            raise Cancelled("the work lease was lost")

    def _failed(self, operation: str, kind: str) -> str:
        return self.operations.move(operation, "fail", self.now(), failure_class=kind)

    def _stage(self, row, held: Callable[[], bool] = lambda: True) -> str:
        plan, ref = self.plan(row)
        frame = self.spark.createDataFrame(plan.edits, "path string, expected_digest string, content string")
        self._go_on(held)
        name = C.stage(self.ledger, frame, row["operation_id"], self.schema_digest, sorted({*plan.source_refs, ref}), self.refs())
        self.operations.move(row["operation_id"], "plan", self.now(), plan_digest=name)
        return name

    def plan(self, row) -> tuple[Plan, str]:
        if self.maintainer is None:
            raise PlanRejected("maintainer_missing")
        source = self.ledger.get("sources", SOURCES).where((F.col("adapter") == row["adapter"]) & (F.col("source_id") == row["source_id"]) & (F.col("version") == row["version"]))
        text = F.decode("content", "UTF-8")
        title = source_title(text)
        seen = source.select("*", text.alias("text"), title.alias("title"), related_terms(title, F.col("adapter"), F.col("source_id")).alias("terms"), source_ref(F.col("adapter"), F.col("source_id"), F.col("version")).alias("ref")).first()
        question = self.spark.createDataFrame([(0, list(seen["terms"]))], "question int, terms array<string>")
        ids = [r["page_id"] for r in self.contexts(question).orderBy("place").collect() if r["page_id"] != graph.CONTROL]
        context = [r.asDict() for r in evidence.read_pages(self.pages(), self.scope, ids).collect()] if ids else []
        plan = self.maintainer(seen.asDict(), context, self.schema)
        if not isinstance(plan, Plan):
            plan = self.decoded(plan)
        self.validate(plan, seen["ref"])
        return plan, seen["ref"]

    def decoded(self, lines: list[str]) -> Plan:
        """The plan in the output lines of a model process; without one, or with too much output, the plan is rejected."""
        rows = self.spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)] or [(0, 0, "")], "run int, line_no int, line string")
        found = E.decoded_plans(rows).first()
        if found["failure"]:
            raise PlanRejected(found["failure"])
        plan = found["plan"]
        return Plan(plan["schema_digest"] or "", list(plan["source_refs"] or []), [(e["path"] or "", e["expected_digest"] or "", e["content"] or "") for e in plan["edits"] or []], plan["rationale"] or "")

    def validate(self, plan: Plan, ref: str) -> None:
        kind = "plan_id int, plan_schema string, schema_digest string, wanted_ref string, source_refs array<string>, rationale string, edits array<struct<path:string,content:string>>"
        frame = self.spark.createDataFrame([(0, plan.schema_digest, self.schema_digest, ref, plan.source_refs, plan.rationale, [(p, c) for p, _, c in plan.edits])], kind)
        failure = E.validated(frame).first()["failure"]
        if failure:
            raise PlanRejected(failure)

    def preview(self, operation: str) -> str:
        """Plan and stage an operation for review; returns the generation that ``apply`` will commit."""
        row = self.operations.row(operation)
        name = C.staged_generation(self.ledger, operation) if row["status"] in ("planned", "awaiting_review") else None
        name = name or self._stage(row)
        self.operations.move(operation, "review", self.now())
        return name

    def apply(self, operation: str, held: Callable[[], bool] = lambda: True) -> str:
        """Commit what was staged for an operation: files, log, projection and the operation's end in one version."""
        row = self.operations.row(operation)
        if row is None:
            raise KeyError(operation)
        if row["status"] in ("committed", "failed"):
            return row["status"]
        try:
            staged = C.load_stage(self.ledger, operation, self.schema_digest)
        except C.BrokenStage:  # the schema or the content is not what was staged
            return self._failed(operation, "stale")
        if staged is None:
            if row["status"] == "received":
                raise KeyError(operation)
            raise StageMissing(operation)
        self._go_on(held)
        token = self.operations.lease(operation, self.clock(), APPLY_LEASE_SECONDS)

        def beside(tx, files: DataFrame, ordinal: int, name: str) -> None:
            new = self._listing(files)
            listing = None if new.isEmpty() else (self._listing(tx.get("files", struct(C.FILES))), new)
            P.advance(tx, self.scope, self._pages_of(files.withColumn("ordinal", F.lit(ordinal))), self.schema_digest, self.clock(), listing)
            self.operations.write(tx, self.operations.moved(tx.get("operations", OPERATIONS), operation, "commit", self.now(), generation=name, lease_token="", lease_expires_at=None))

        def check(newest: Snapshot) -> None:
            self._go_on(held)
            self.operations.fenced(operation, token, newest)

        try:
            generation = C.commit(self.ledger, staged, operation, self.schema_digest, C.staged_refs(self.ledger, operation), self.refs(), beside, check)
        except (C.StaleEdit, C.BrokenPlan) as error:
            return self._failed(operation, "stale" if isinstance(error, C.StaleEdit) else "content")
        if self.operations.row(operation)["status"] == "applying":  # the files had been committed before
            return self.operations.move(operation, "commit", self.now(), generation=generation)
        return "committed"

    def file(self, question: str, limits: ReadLimits | None = None) -> str:
        """File a query's result as a source; the maintainer sees it like any other."""
        row = evidence.filed(self.retrieve(question, limits).hits, question).first()
        return self.ingest(row["adapter"], row["source_id"], row["version"], row["content"].encode(), "application/json")

    def scheduler(self, **settings):
        """A scheduler over this engine; start() begins its scans."""
        from loamstack.streaming.scheduler import Scheduler

        context, gone = self.spark.sparkContext, set()

        def run(operation: str) -> None:
            # the group by which a lost lease cancels this operation's jobs; between two jobs the run asks itself
            gone.discard(operation)
            context.setJobGroup(operation, operation, interruptOnCancel=True)
            try:
                self.run(operation, lambda: operation not in gone)
            except Exception as error:
                if operation in gone and not isinstance(error, Cancelled):  # a job that was cancelled fails in its own way
                    raise Cancelled("the work lease was lost") from error
                raise

        def lost(operation: str) -> None:
            gone.add(operation)
            context.cancelJobGroup(operation)

        settings = {"lost": lost, **settings}
        return Scheduler(self.claim, run, lambda i, t: self.operations.renew(i, t, self.now()), **settings)

    # --- maintenance

    def lint(self, suggest=None) -> DataFrame:
        """Findings over sources, pages, links, index, log and projection."""
        pages, files, sources = self.snapshot(), self.files(), self.ledger.get("sources", SOURCES)
        index = files.where("path = 'wiki/index.md'").select(F.col("content").alias("body"))
        key = (F.col("adapter"), F.col("source_id"), F.col("version"))
        same = F.sha2("content", 256) == F.col("digest")
        raw = sources.select(raw_location(F.lit(self.scope), *key).alias("path"), source_ref(*key).alias("ref"), "digest", same.alias("valid"), F.when(~same, "source_digest_mismatch").alias("error_class"))
        row = P.snapshot_digest(pages, wiki_links(pages)).first()
        found = lint.raw_findings(raw).unionByName(lint.page_findings(pages, lint.parsed(pages), self.refs())).unionByName(lint.link_findings(pages, wiki_links(pages), index))
        found = found.unionByName(lint.log_findings(C.log_lines(self.ledger.get("log", struct(C.LOG))), self.schema_digest, files))
        found = found.unionByName(lint.projection_finding(self.ledger.get("state", P.STATE), row["snapshot_digest"] if row else ""))
        return lint.ordered(found.unionByName(lint.suggestions(found, suggest)))

    def lint_links(self) -> DataFrame:
        """The findings of ``lint`` on links, orphans and the index, from the counts that commits keep; no text is read but the index's."""
        at = self.ledger.snapshot()
        index = self._listing(self.ledger.get("files", struct(C.FILES), at))
        counts, links = (self.ledger.get(name, P.TABLES[name][0], at).where(F.col("scope") == self.scope) for name in ("counts", "links"))
        own = lint.finding(index.where(unclosed(F.col("body"))), "index.malformed", lint.ERROR, F.lit(lint.INDEX_PATH))
        return lint.ordered(own.unionByName(refcounts.counted_findings(counts, links)))

    def bootstrap(self, files: DataFrame) -> dict:
        """Import a Markdown tree (path, content binary) into an empty engine: a source for every file, a page for every note, the assets, an index."""
        from loamstack.sources import bootstrap as B

        if self.ledger.generation("files") or self.ledger.generation("sources"):
            raise RuntimeError("bootstrap needs an empty engine")
        every = B.inputs(files.select("path", "content"))
        names = B.catalog(every)
        digest = F.sha2("content", 256)
        tx = self.ledger.begin()
        tx.guard("files")
        tx.put("sources", every.select(F.lit(self.scope).alias("scope"), F.lit("bootstrap").alias("adapter"), F.col("path").alias("source_id"), digest.alias("version"), digest.alias("digest"), F.lit("text/markdown").alias("media_type"), self.now().alias("received_at"), "content"))
        tx.put("assets", every.where("NOT note").select(F.concat(F.lit("wiki/assets/"), "path").alias("path"), digest.alias("digest"), "content"))
        notes = every.where("note").select("path", F.decode("content", "UTF-8").alias("raw"), digest.alias("found")).withColumn("meta", frontmatter(F.col("raw")))
        own = F.when(F.col("meta.ok"), F.regexp_replace("raw", r"(?s)\A\s*---\s*?\n.*?\n\s*---\s*?(\n|\z)", "")).otherwise(F.col("raw"))
        base = F.regexp_replace(B.base_name(F.col("path")), r"(?i)\.md$", "")
        told = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
        bodies = B.rewritten(notes.withColumn("body", own), names)
        pages = bodies.select(
            F.concat(F.lit("notes/"), B.reference_key(F.col("path"))).alias("page_id"),
            F.coalesce(told(F.col("meta.title")), told(page_title(F.col("body"))), base).alias("title"),
            F.array(source_ref(F.lit("bootstrap"), F.col("path"), F.col("found"))).alias("refs"), F.col("meta.extras").alias("extras"), "body",
        ).withColumn("path", F.concat(F.lit("wiki/"), "page_id", F.lit(".md")))
        content = pages.select("path", "page_id", "title", B.rendered_page("page_id", "title", "refs", "extras", "body").alias("content"))
        index = B.rendered_index(pages).select(F.lit("wiki/index.md").alias("path"), F.col("body").alias("content"))
        both = content.select("path", "content").unionByName(index)
        tx.put("files", both.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), "content"))
        tx.commit(bootstrap=True)
        P.ensure(self.ledger, self.scope, self.snapshot(), self.schema_digest, self.clock(), self._listing(self.files()))
        n = every.agg(F.count(F.when(F.col("note"), 1)), F.count(F.when(~F.col("note"), 1))).first()
        return {"notes": n[0], "assets": n[1]}


__all__ = ["OPERATIONS", "RETRYABLE", "Cancelled", "Engine", "InvalidQuery", "Plan", "PlanRejected", "StageMissing"]
