"""Tasks of tables with many rows."""

from metaloom.functions.spread import spread


def test_tasks_of_large_tables_grow(spark):
    assert spread(spark.range(1_000_000)).rdd.getNumPartitions() == 64
    assert spread(spark.range(2_000_000)).rdd.getNumPartitions() == 100
