"""Schemas, bounds and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def struct(text: str) -> T.StructType:
    """A schema from 'name kind, ...' without a session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


PAGES = struct("scope string, page_id string, path string, title string, body string, digest string, source_refs array<string>, untrusted boolean, updated_at timestamp")
LINKS = struct("scope string, from_page string, to_page string, relation string")
STATE = struct("scope string, schema_digest string, snapshot_digest string, page_count long, link_count long, ready_at timestamp")
FINDINGS = struct("code string, severity string, path string, page_id string, message string, refs array<string>")
ENVELOPES = struct("scope string, adapter string, source_id string, version string, digest string, media_type string, content binary, received_at timestamp")
OPERATIONS = struct(
    "operation_id string, scope string, adapter string, source_id string, version string, digest string, schema_digest string, status string, attempt int, plan_digest string, "
    "failure_class string, generation string, lease_token string, lease_expires_at timestamp, created_at timestamp, updated_at timestamp, media_type string, manifest_ref string, "
    "schema_version string, schema_snapshot binary, work_attempt int, work_token string, work_expires_at timestamp, work_ready_at timestamp"
)
LOG_RECORD = "operation_id string, generation string, schema_digest string, source_refs array<string>, files array<string>"

# Words that frame a question and carry no content.
FRAMING_WORDS = ("what", "why", "how", "when", "where", "who", "which", "is", "are", "was", "were", "do", "does", "did")
# Bounds of queries, pages, plans, sources and the scheduler.
MAX_TERMS, MAX_TERM_RUNES = 32, 256
OMISSION = "…"
PAGE_LIMIT, MAX_PAGE_LIMIT = 20, 100
MAX_SOURCE_BYTES = MAX_SCHEMA_BYTES = 4 << 20
TITLE_RUNES = 256
PLAN_FILES, PLAN_FILE_BYTES, PLAN_REFS, PLAN_RATIONALE = 32, 256 << 10, 64, 32 << 10
APPLY_LEASE_SECONDS, WORK_LEASE_SECONDS, SCAN_SECONDS, CLAIM_BATCH, WORK_SCAN = 300, 30, 5, 16, 100
TERMINAL = ("committed", "failed")


class InvalidQuery(ValueError):
    """The query has no term, or too many."""


class InvalidScope(ValueError):
    """A blank scope."""


class SourceConflict(ValueError):
    """One source revision with two digests."""


class LimitExceeded(ValueError):
    """A read passes a bound that may not be truncated."""


@dataclass(frozen=True)
class ReadLimits:
    """Bounds of a read; zero means the default."""

    pages: int = PAGE_LIMIT
    bytes: int = 4 << 20
    characters: int = 32 << 10
    depth: int = 8
    seconds: int = 30

    def __post_init__(self):
        if min(self.pages, self.bytes, self.characters, self.depth, self.seconds) < 0:
            raise ValueError("read limits can't be negative")

    @property
    def page_limit(self) -> int:
        return page_limit(self.pages)


def page_limit(asked: int) -> int:
    """A page limit within its bounds: 20 where none is asked, at most 100."""
    return PAGE_LIMIT if asked <= 0 else min(asked, MAX_PAGE_LIMIT)


def require_scope(scope: str) -> str:
    if not scope or not scope.strip():
        raise InvalidScope("a scope is required")
    return scope
