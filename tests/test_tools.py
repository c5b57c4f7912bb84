import pytest
from pyspark.sql import functions as F

from loamstack.engine import Engine
from loamstack.tools import DeadlineExceeded, InvalidArgument, ScopeOverride, ToolNotFound, Tools, deadline


def test_tools_keep_the_scope_and_ask_the_authorizer(spark, tmp_path):
    asked = []

    def authorize(scope, name):
        asked.append((scope, name))
        if name == "ingest" and len(asked) > 1:
            raise PermissionError(name)

    tools = Tools(Engine(spark, str(tmp_path), "team"), authorize)
    assert [t.name for t in tools.listed() if not t.read_only] == ["ingest"]
    source = {"adapter": "adr", "source_id": "7", "version": "1", "content": "# Leases\nLeases renew."}
    with pytest.raises(ScopeOverride):
        tools.call("ingest", source | {"scope": "rival"})
    with pytest.raises(ToolNotFound):
        tools.call("delete")
    for bad in ({}, {"query": " "}, {"query": 3}, {"query": "x", "limit": "9"}):
        with pytest.raises(InvalidArgument):
            tools.call("retrieve", bad)
    assert asked == []
    made = tools.call("ingest", source)
    assert made["status"] == "queued" and made["operation_id"].startswith("team:adr:7@1#")
    assert tools.call("operation", {"id": made["operation_id"]})["status"] == "queued"
    assert tools.call("retrieve", {"query": "when do leases renew"}) == {"evidence": [], "citations": []}
    with pytest.raises(PermissionError):
        tools.call("ingest", source)
    with pytest.raises(KeyError):
        tools.call("operation", {"id": "none"})
    assert [x for x, _ in asked] == ["team"] * 5


def test_a_deadline_cancels_the_jobs_of_its_block(spark):
    slow = spark.range(1 << 40).select(F.sum(F.xxhash64("id") % 7))
    with pytest.raises(DeadlineExceeded):
        with deadline(spark, 1):
            slow.collect()
    with deadline(spark, 60):
        assert spark.range(10).count() == 10
    with deadline(spark, 0):
        assert spark.range(3).count() == 3
    with pytest.raises(ZeroDivisionError):
        with deadline(spark, 60):
            1 / 0
