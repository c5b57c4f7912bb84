import corpus_pipeline as P
from loamstack.llm import cotrain, decontaminate, simhash
from loamstack.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "benchmark", "tokens"]
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(written(stage(spark, tables[-1], sf), name))
        if name != "tokens":
            assert tables[-1].columns == COLUMNS
    rows = [[tuple(r) for r in t.collect()] for t in tables[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r[0] for r in rows[1]}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) / len(labels) > 0.97
    stay = {}
    for r in rows[1]:
        stay[r[1]] = max(stay.get(r[1], r), r)
    assert sorted(stay.values()) == sorted(rows[2])
    sets = {r[0]: shingles(r[1]) for r in rows[2]}
    left = {r[0] for r in rows[3]}
    assert left <= sets.keys()
    for i in sets.keys() - left:  # what goes is similar to something
        assert max(jaccard(sets[i], sets[j]) for j in sets if j != i) >= 0.8
    ids = sorted(left)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.8]
    hit = {r.doc_id for r in decontaminate.contamination(tables[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
    assert {r[0] for r in rows[4]} == left - hit
    assert sorted(r.doc_id for r in tables[-1].collect()) == sorted(r[0] for r in rows[4])


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None, None, None, None, None), (None, "", None, None, None), (2, "b", "en", "s", 1), (3, "b", "en", "s", 1), (3, "c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text or "") for r in P.exact(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, ""), (3, "b"), (3, "c")], key=str)
    assert simhash.distinct_rows(P.exact(spark, docs.limit(0), "")).count() == 0
    assert cotrain.accepted(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 7


def test_two_results_at_once_and_tables_that_go_when_nothing_reads_them(spark):
    from loamstack.llm import common

    one = spark.createDataFrame([(i, f"text {i % 7}", "en", "s", 1) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    two = spark.createDataFrame([(i, f"other {i % 5}", "en", "s", 1) for i in range(40)], one.schema)
    a = P.exact(spark, one, "")
    b = P.exact(spark, two, "")
    part = a.select("text")
    near = P.near(spark, a, "")
    del a
    common.sweep(spark)
    assert (part.count(), b.count(), near.count(), b.distinct().count()) == (7, 5, 7, 5)
    before = len(common._WRITTEN)
    del part, b, near
    assert common.sweep(spark) > 0 and len(common._WRITTEN) < before


def test_column_names_of_any_kind_pass_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS `a.b`", "doc_id AS `__hits`", "'v' AS `x y`", "2 AS near_row", "3 AS `sieve_row`", "array(doc_id) AS hits")
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, sf), name)
        if name != "tokens":
            assert docs.columns == [*COLUMNS, "a.b", "__hits", "x y", "near_row", "sieve_row", "hits"]
            assert docs.where("doc_id <> __hits OR hits[0] <> doc_id OR `a.b` <> 1 OR `x y` <> 'v'").count() == 0 and docs.count() > 0
