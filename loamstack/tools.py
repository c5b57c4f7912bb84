"""The engine's operations as named tools for a host: plain arguments in, plain data out.

The scope is the engine's own; no argument changes it. An authorizer, if the host has one, is asked before each call and
refuses by raising. A call that Spark has not answered within the limits' ``seconds`` has its jobs cancelled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from loamstack.deadline import DeadlineExceeded, deadline
from loamstack.engine import Engine
from loamstack.model import ReadLimits
from loamstack.operators import evidence


class ToolNotFound(KeyError):
    """No tool of that name."""


class InvalidArgument(ValueError):
    """An argument is missing, blank, unknown or not text."""


class ScopeOverride(ValueError):
    """A call that names a scope."""


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    read_only: bool
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()


@dataclass
class Tools:
    engine: Engine
    authorize: Callable[[str, str], None] | None = None
    limits: ReadLimits = field(default_factory=lambda: ReadLimits(characters=1024))

    def listed(self) -> list[Tool]:
        return [
            Tool("retrieve", "Evidence for a question, with citations", True, ("query",)),
            Tool("ingest", "Accept a source revision and reserve its operation", False, ("adapter", "source_id", "version", "content"), ("media_type",)),
            Tool("operation", "The status of one operation", True, ("id",)),
        ]

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """The answer of the tool ``name``."""
        given = dict(arguments or {})
        if "scope" in given:
            raise ScopeOverride("the scope is not an argument")
        tool = next((t for t in self.listed() if t.name == name), None)
        if tool is None:
            raise ToolNotFound(name)
        unknown = set(given) - {*tool.required, *tool.optional}
        bad = [k for k in tool.required if not isinstance(given.get(k), str) or not given[k].strip()] + [k for k in tool.optional if k in given and not isinstance(given[k], str)]
        if unknown or bad:
            raise InvalidArgument(", ".join(sorted([*unknown, *bad])))
        if self.authorize is not None:
            self.authorize(self.engine.scope, name)
        return getattr(self, f"_{name}")(**given)

    def _retrieve(self, query: str) -> dict:
        with deadline(self.engine.spark, self.limits.seconds):
            return json.loads(evidence.encoded(self.engine.retrieve(query, self.limits)).first()["result"])

    def _ingest(self, content: str, **source: str) -> dict:
        # a write is never cut off: its operation may have been reserved
        found = self.engine.ingest(content=content.encode(), **source)
        return {"operation_id": found, "status": self.engine.operation(found)["status"]}

    def _operation(self, id: str) -> dict:
        with deadline(self.engine.spark, self.limits.seconds):
            return self.engine.operation(id)


__all__ = ["DeadlineExceeded", "InvalidArgument", "ScopeOverride", "Tool", "ToolNotFound", "Tools", "deadline"]
