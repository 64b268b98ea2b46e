"""Filter interaction audit (operator 11): what each filter of a cascade removes, in every order of the filters.

Each document has a mask, one bit for each filter that it fails. Documents are pre-aggregated into cells (part, mask, quality, toxicity), which
are unpivoted against the steps of all orders: one row for each cell, order and step. A running bit-or window over an order's steps holds the
failures before a step; conditional sums of the cells' sizes give the step's metrics, and a filter's Shapley total is a window over
all its steps. There are k! * k rows for each cell and at most 4 * 2^k cells for each part, whatever the number of documents.

Texts are compared by SHA-256. Filter E needs the smallest doc_id of each text, which is found by groups of (text, cell): copies
are aggregated where they are read, so the group of a text that a third of all rows share meets as few rows in one task.
A null text counts as empty. A null doc_id is neither smaller nor larger than another: such a row never fails E, and has no labels. Of rows
equal in doc_id and text none fails E by the other; each counts. A document with several labels has quality (toxic) 1 if any says so. A null
lang is the part with the empty string. Without documents there are no parts and no rows; other columns don't count.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.llm.common import table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
BREAKS = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """The bits of filters A to D, which a text decides alone."""
    words = F.array_remove(F.split(text, BREAKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    fails = [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * upper.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, digest, mask (of A to D), doc_id, good, toxic and the number of rows that agree in these."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    joined = rows.where("doc_id IS NOT NULL").join(known.hint("merge"), "doc_id", "left")  # a merge join, as a hot doc_id can be split then
    nameless = rows.where("doc_id IS NULL").withColumns({"quality": F.lit(False), "toxic": F.lit(False)})
    flag = lambda c: F.coalesce(c, F.lit(False))
    return joined.unionByName(nameless).select("part", "digest", "mask", "doc_id", flag("quality").alias("good"), flag("toxic").alias("toxic"), "n")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The number of documents of each part, mask, good and toxic."""
    named = F.col("doc_id").isNotNull()
    groups = labelled(docs, labels).groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("nameless")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # of a text there are four rows for each part at most
    groups = groups.withColumn("least", least)
    fresh = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct("mask", fresh.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - fresh).alias("n")))
    rows = groups.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "good", "toxic", "c.mask", "c.n")
    return rows.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(sizes: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The metrics of each part, order of filters and step, from cells (part, mask, good, toxic, n); bit k of a mask is the k-th filter's."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = sizes.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bit = sum((F.when(F.col("filter") == name, 1 << k).otherwise(0) for k, name in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    one = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(one), F.lit(0)))
    removed = (F.col("fails") != 0) & (F.col("earlier") == 0)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    metrics = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("fails") == 0) & (F.col("earlier") == 0)).alias("kept"),
        total(removed).alias("removed"),
        total((F.col("fails") != 0) & (F.col("earlier") != 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")).drop("filter")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
