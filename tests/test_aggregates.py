"""Aggregates as Arrow functions: every way of dealing rows gives the same, and no task holds a whole group."""

import pyarrow.compute as pc
from metaloom.operators import aggregates
from pyspark.sql import functions as F


def pictures(rows):
    return rows.select("domain", F.when(F.col("url").isNotNull(), aggregates.candidate(F.col("url"), F.col("score"), F.col("why"))).alias("best"))


def best(rows, parts=aggregates.PARTS):
    return {r.domain: r.best and r.best.asDict() for r in aggregates.aggregated(pictures(rows), ["domain"], "best", aggregates.best_picture, parts).collect()}


def test_best_pictures(spark):
    given = [("a", "u2", 5.0, "x"), ("a", "u1", 5.0, "y"), ("a", "u1", 5.0, "w"), ("a", "u0", 4.0, "x"), (None, "n", 1.0, None), ("b", None, None, None), ("b", "v", -3.0, ""), ("c", None, None, None)]
    rows = spark.createDataFrame(given, "domain string, url string, score double, why string")
    expected = {"a": {"n": 4, "score": 5.0, "url": "u1", "why": "w"}, None: {"n": 1, "score": 1.0, "url": "n", "why": None}, "b": {"n": 1, "score": -3.0, "url": "v", "why": ""}, "c": None}
    for parts in (1, 7):
        for dealt in (rows, rows.repartition(5), rows.coalesce(1)):
            assert best(dealt, parts) == expected
    assert best(rows.limit(0)) == {}


def test_a_group_of_most_rows_is_merged_before_it_is_shuffled(spark):
    rows = spark.range(60_000, numPartitions=6).select(F.when(F.col("id") % 100 < 90, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("domain"), F.concat(F.lit("u"), F.col("id")).alias("url"), (F.col("id") * 7919 % 60_000).cast("double").alias("score"), F.lit("w").alias("why"))
    plain = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("score", "url", "why"), "score").alias("b")).select("domain", "n", "b.*")
    assert best(rows) == {r.domain: {"n": r.n, "score": r.score, "url": r.url, "why": r.why} for r in plain.collect()}


def test_other_merges_and_names(spark):
    rows = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (2, None, 4), (2, None, None)], "part int, k0 string, v int")
    found = aggregates.aggregated(rows, ["part", "k0"], "v", lambda a: pc.sum(a).as_py())
    assert found.columns == ["part", "k0", "v"] and sorted(map(tuple, found.collect())) == [(1, "x", 5), (2, None, 4)]
    whole = rows.groupBy("part").agg(aggregates.merged_by(lambda a: pc.max(a).as_py(), "int")("v").alias("m"))
    assert sorted(map(tuple, whole.collect())) == [(1, 3), (2, 4)]


def test_few_values_of_a_group_are_handed_on(spark):
    """A merge in a batch costs more than the rows of a rare group: those with FEW values or more are merged there, the others once."""
    calls = spark.sparkContext.accumulator(0)

    def most(values):
        calls.add(1)
        return pc.max(values).as_py()

    rows = spark.range(9_000, numPartitions=3).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    found = {r.k: r.v for r in aggregates.aggregated(rows, ["k"], "v", most).collect()}
    assert found == {r.k: r.v for r in rows.groupBy("k").agg(F.max("v").alias("v")).collect()}
    assert calls.value <= 2 * 1001 + 3 + 3  # both levels after the shuffle, and the frequent group in each batch
