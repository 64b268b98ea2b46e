"""Reports over any of several columns, with distinct counts that can be stored and added up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's registers: the standard error of an estimate is about 1.04 / 2^(PRECISION / 2), 1.6 %.
PRECISION = 12


def counted(rows: DataFrame, by: list[str], distinct: str, precision: int = PRECISION) -> DataFrame:
    """by, n and sketch (of the distinct values of a column; nulls don't count) of each combination: what reports are made of, a day's for example."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, precision).alias("sketch"))


def added(parts: DataFrame, by: list[str]) -> DataFrame:
    """Several counted() tables, put under each other, as one."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def cube(parts: DataFrame, by: list[str]) -> DataFrame:
    """A row for each combination of values of any of the columns, from counted(): by, level (a bit for each column that all values are taken together of, the last one's is 1), n and about.

    Combinations are made of the counted rows, not of what they count, so the 2^k-fold expansion is as small as the table of combinations.
    """
    found = parts.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    return found.select(*by, "level", "n", "about")
