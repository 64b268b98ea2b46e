from metaloom.llm import common
from pyspark.sql import functions as F


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    for buckets in (1, 7, 64):
        rows = common.ranked(df, ["k"], ["x"], "r", buckets).collect()
        for k in range(3):
            assert sorted(r.r for r in rows if r.k == k) == list(range(len([r for r in rows if r.k == k])))
    assert sorted(r.r for r in common.ranked(df, [], ["x"], "r", 5).collect()) == list(range(1000))
    assert [r.r for r in common.numbered(df, [F.col("x").desc()], "r").orderBy(F.desc("x")).collect()] == list(range(1000))


def test_tables_can_be_dropped(spark):
    kept = common.cut(spark.range(5).toDF("a"))
    assert kept.count() == 5
    common.drop_tables(spark)
    assert common.cut(spark.range(3).toDF("a")).count() == 3


def test_one_batch_at_a_time(spark):
    df = spark.range(2500).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("t"))
    found = common.map_rows(df, lambda: lambda ids, ts: [ids, [t is None for t in ts]], "id bigint, empty boolean")
    assert found.where("empty").count() == 1250
