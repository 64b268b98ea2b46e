"""Small rows that cost much are dealt to tasks by their number."""

from metaloom.functions.spread import spread
from metaloom.plans import catalogue
from pyspark.sql import functions as F


def test_a_small_file_becomes_many_tasks(spark, tmp_path):
    for name, key in (("part", "p_partkey"), ("customer", "c_custkey")):
        spark.range(20_001).select(F.col("id").alias(key), (F.col("id") % 50).cast("int").alias("p_size"), F.lit("n").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        rows = catalogue.read(spark, str(tmp_path), name)
        counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("t")).count().collect()]
        assert len(counts) == 5 and sum(counts) == 20_001 and max(counts) < 5_000
    found = catalogue.QUERIES["reddit_filter"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5 and found.select("p_partkey").distinct().count() == 20_001
    assert catalogue.QUERIES["adapter_facebook"](spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_few_rows_stay_where_they_are(spark):
    rows = spark.range(10).coalesce(1)
    assert spread(rows).rdd.getNumPartitions() == 1 and spread(rows.where("id < 0")).count() == 0


def test_media_of_all_kinds_come_from_one_pass(spark):
    for name in ("json_media", "video_audio_candidates"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_ranked_lines_are_rows_not_lists(spark):
    for name in ("best_image", "duplicate_penalty"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
