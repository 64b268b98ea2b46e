"""Aggregates that are functions of Arrow arrays, merged in levels so that no task holds all values of a group.

    best = aggregated(rows, ["domain"], "picture", best_picture)

A merge turns an array of values into one value of the same kind. It is applied three times: to a group's values within each batch, before
anything is shuffled, then to parts of what that leaves, then to what the parts leave. So its result mustn't depend on order or grouping, as is so for sums,
extremes and sets. A merge costs more than a row, so fewer than FEW values of a group in a batch are handed on as they are, and only groups that
hold a hundredth of a batch are dealt to parts: those give the second level about n / (batch rows * PARTS) values in a task and the last one PARTS at most,
rarer ones FEW - 1 values for each batch at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from metaloom.functions.ship import ship

#: Tasks that share the values of one group.
PARTS = 256
#: So many values of a group in one batch are merged before the shuffle.
FEW = 8

Merge = Callable[[pa.Array], object]


def merged_by(merge: Merge, kind) -> Callable[[Column], Column]:
    """A merge as an aggregate function of a column of that kind, for groupBy().agg(), windows and SQL."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Scalar:
        return pa.scalar(merge(values), values.type)

    return run


def aggregated(rows: DataFrame, by: list[str], value: str, merge: Merge, parts: int = PARTS) -> DataFrame:
    """by and the merged value of each group of rows. Nulls are groups of their own in by, and values that merge gets; an empty table has no groups."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    chosen = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col(value).alias("v"))
    keys, aggregate = [f"k{i}" for i in range(len(by))], merged_by(merge, kinds[value])
    schema = StructType([*[StructField(k, kinds[c]) for k, c in zip(keys, by, strict=True)], StructField("v", kinds[value]), StructField("hot", BooleanType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table([*[batch.column(k) for k in keys], pa.array(range(batch.num_rows))], names=[*keys, "at"])
            groups = table.group_by(keys, use_threads=False).aggregate([("at", "list"), ("at", "count")])
            few = pc.less(groups.column("at_count"), FEW)
            alone = groups.filter(few)
            if len(alone):
                rest = batch.take(pa.concat_arrays([c.flatten() for c in alone.column("at_list").chunks]))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([False] * rest.num_rows)], names=[*keys, "v", "hot"])
            groups = groups.filter(pc.invert(few)).combine_chunks()
            if len(groups):
                values, places = batch.column("v"), groups.column("at_list").combine_chunks()
                made = pa.array([merge(values.take(p.values)) for p in places], values.type)
                hot = pa.array([n * 100 >= batch.num_rows for n in groups.column("at_count").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[pa.concat_arrays(groups.column(k).chunks) for k in keys], made, hot], names=[*keys, "v", "hot"])

    part = F.when(F.col("hot"), F.pmod(F.xxhash64(F.to_json(F.struct("v"))), F.lit(parts))).otherwise(0)
    first = chosen.mapInArrow(within, schema).withColumn("part", part)
    second = first.groupBy(*keys, "part").agg(aggregate("v").alias("v"))
    done = second.groupBy(*keys).agg(aggregate("v").alias("v"))
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("v").alias(value))


def candidate(url: Column, score: Column, why: Column) -> Column:
    """A picture as best_picture() takes it, standing for itself."""
    return F.struct(F.lit(1).cast("bigint").alias("n"), score.cast("double").alias("score"), url.alias("url"), why.alias("why"))


def best_picture(values: pa.Array) -> dict | None:
    """The picture with the highest score (then the smallest URL and reasons) and how many there were; null candidates don't count."""
    values = values.drop_null()
    if not len(values):
        return None
    order = pa.table([pc.negate(pc.struct_field(values, "score")), pc.struct_field(values, "url"), pc.struct_field(values, "why")], names=["score", "url", "why"])
    first = pc.select_k_unstable(order, 1, [("score", "ascending"), ("url", "ascending"), ("why", "ascending")])
    return values[first[0].as_py()].as_py() | {"n": pc.sum(pc.struct_field(values, "n")).as_py()}
