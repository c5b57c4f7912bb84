"""Every registered query of the engine against its DuckDB twin, and the optional part's guard."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from loamstack.plans import catalog

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    rows = df.collect()
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str) == want


def test_the_rest_imports_without_the_optional_part(tmp_path):
    shutil.copytree(REPO / "loamstack", tmp_path / "loamstack", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_two_phase' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    source = "\n".join(p.read_text() for p in (REPO / "loamstack").rglob("*.py") if "llm" not in p.parts)
    assert "loamstack.llm" not in source and "corpus_pipeline" not in source
