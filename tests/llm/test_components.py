import random

from loamstack.llm.common import release, shared_dir, written
from loamstack.llm.components import components


def test_paths_hubs_and_cycles(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(3000, 3000), (3001, 3002), (3002, 3001)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components(written(spark.createDataFrame(links, "a long, b long"), "t")).collect()}
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1300)} | {2000 + i: 2000 for i in range(30)} | {3001: 3001, 3002: 3001}
    assert got == want
    assert components(written(spark.createDataFrame([], "a long, b long"), "t")).count() == 0


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(5), "x")
    folder = shared_dir(spark).removeprefix("file:").lstrip("/")
    assert df.inputFiles() and all(folder in f for f in df.inputFiles()) and df.count() == 5
    release(spark)
