from pyspark.sql import functions as F

from loamstack.llm.common import lean, written
from loamstack.llm.sampling import sampled, thinned


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    one, two = (sorted(r.doc_id for r in sampled(df, ["doc_id"], 500).collect()) for _ in range(2))
    assert one == two and 400 < len(one) < 600
    assert {r.lang: r["count"] for r in sampled(df, ["doc_id"], 500, "lang").groupBy("lang").count().collect()}.keys() == {"a", "b"}
    assert sampled(df.limit(0), ["doc_id"], 5, "lang").count() == 0 and sampled(df.limit(3), ["doc_id"], 5).count() == 3
    hot = written(spark.range(30000).select(F.lit(1).alias("doc_id")), "hot")
    assert thinned(hot, 1000).count() < 1400 and thinned(hot, 50000).count() == 30000


def test_smaller_batches_unless_the_session_sets_its_own(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    lean(spark.range(1))
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, "77")
    lean(spark.range(1))
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, before)


def test_rows_without_an_id_are_sampled_too(spark):
    rows = [(None, f"text {i}", "ab"[i % 2]) for i in range(4000)]
    got = sampled(spark.createDataFrame(rows, "id long, text string, lang string"), ["id"], 200, "lang")
    counts = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
    assert all(120 < counts[x] < 280 for x in "ab")
