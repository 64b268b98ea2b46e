"""What the corpus operators share: table access, cutting lineage, batches of bounded size and distributed ranks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.functions.batches import pieces
from metaloom.functions.shared import _folders, delete, shared_folder
from metaloom.functions.ship import ship

#: Rows and bytes of text that a Python function gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Rows of a bucket of ranked() and running(), on average.
BUCKET_ROWS = 20_000
#: Words as the contracts define them: runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Written(threading.local):
    """Each thread's own tables, so that operators built side by side don't delete each other's."""

    def __init__(self):
        self.tables: list[tuple[str, DataFrame]] = []


_written = _Written()


def drop_tables(spark: SparkSession) -> None:
    """Deletes what cut() has written so far in all threads, once no result that reads it is needed any more."""
    for base, folder in list(_folders.items()):
        if base:
            delete(spark, folder)
            del _folders[base]
    _written.tables.clear()


def mark() -> int:
    """A point in time of this thread for release()."""
    return len(_written.tables)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables that cut() has written since a mark(), but for those in keep (as cut() returned them)."""
    kept = [(path, df) for path, df in _written.tables[since:] if any(df is k for k in keep)]
    for path, df in _written.tables[since:]:
        if not any(df is k for k in keep):
            delete(spark, path)
    _written.tables[since:] = kept


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them again, which forgets the plan behind them.

    A table rather than a checkpoint, as a checkpoint hands on the plan's size estimate: over rounds of joins that
    number gains millions of digits, while a table's size is its files'.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _written.tables.append((path, found))
    return found


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Applies a function of whole columns, built once in each task, to batches of df.

    make() returns a function of the batch's columns (as Python lists, in df's order) that returns
    the lists of the result's columns. Only the columns in df cross to Python.
    """
    ship(df.sparkSession)
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in df.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for whole in batches:
            for batch in pieces(whole, BATCH_ROWS, BATCH_BYTES):
                f = f or make()
                made = f(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return simple[kind]


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the contracts' folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str, buckets: int, by: list[str] | None = None) -> DataFrame:
    """Adds the sum of weight over the rows before each row, among those that share keys, without bringing a key's rows into one task.

    Rows are dealt into hash buckets of by (the order columns by default; keys aren't null); a bucket's rows are
    summed up in order and start after the rows of the key's earlier buckets. Rows that agree in keys and order
    are interchangeable. buckets bounds the offsets to as many rows for each key.
    """
    spread = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(name), *(by or order)), F.lit(buckets))).withColumn("_w", weight.cast("long"))
    start = before(spread.groupBy(*keys, "_b").agg(F.sum("_w").alias("_n")), keys, "_b", "_n", "_start")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spread.withColumn("_i", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(start.drop("_n"), [*keys, "_b"])
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("long"))
        .drop("_b", "_i", "_start", "_w")
    )


def before(sums: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over the rows before each row of a table of pre-aggregated sums."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, buckets: int, by: list[str] | None = None) -> DataFrame:
    """Adds the gapless rank from 0 of each row among those that share keys (see running())."""
    return running(df, keys, order, F.lit(1), name, buckets, by)


def buckets_for(rows: int, keys: int = 1) -> int:
    """Buckets of at most about BUCKET_ROWS rows for ranked(), whatever the number of rows."""
    return max(256, rows // (BUCKET_ROWS * keys))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's rank from 0 in a total order, by sorted ranges; df is written out once."""
    ranges = cut(df.orderBy(*order).withColumn("_p", F.spark_partition_id()))
    start = before(ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")), [], "_p", "_n", "_start")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranges.withColumn("_i", inside).join(start, "_p").withColumn(name, (F.col("_start") + F.col("_i")).cast("long")).drop("_p", "_n", "_start", "_i")
