"""Streams with state: sessions of users, what has been seen of a URL, and documents that belong to pages.

All state is bounded by watermarks: a session is written once no row can change it, a URL is forgotten after a time without rows, and a page waits for
its documents no longer than they may take. Rows later than the watermark are dropped by Spark and counted in the query's progress (late_rows()).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from metaloom.functions.shared import shared_folder
from metaloom.functions.ship import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(rows: DataFrame, key: str, time: str, gap: str = "30 minutes", delay: str = "1 hour", **sums) -> DataFrame:
    """key, first and last (times), n and sums (name=Column) of each session: rows of a key that follow each other within the gap.

    Works on tables and on streams; a stream writes a session when the watermark has passed its end.
    """
    timed = rows.withWatermark(time, delay) if rows.isStreaming else rows
    window = F.session_window(F.col(time), gap).alias("_session")
    found = timed.groupBy(key, window).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return found.drop("_session")


SEEN = "url string, first timestamp, last timestamp, times bigint, changes bigint, content bigint"


class Seen(StatefulProcessor):
    """What a URL's rows have shown so far; forgotten when the watermark is forget_ms past its last row."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "first bigint, last bigint, times bigint, changes bigint, content bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["at", "content"])
        first, last, times, changes, content = self.state.get() if self.state.exists() else (None, None, 0, 0, None)
        for at, now in zip(part["at"].tolist(), part["content"].tolist(), strict=True):
            first = at if first is None else min(first, at)
            changes += content is not None and now != content and at >= last
            if last is None or at >= last:
                last, content = at, now
            times += 1
        self.state.update((first, last, times, int(changes), content))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.forget_ms)
        yield pd.DataFrame({"url": [key[0]], "first": [pd.Timestamp(first, unit="us")], "last": [pd.Timestamp(last, unit="us")], "times": [times], "changes": [int(changes)], "content": [content]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_seen(pages: DataFrame, time: str, content: str, delay: str = "1 hour", forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """SEEN of each URL of a stream (url, time, content), a row for each batch that brings rows of it; the last row counts.

    changes counts how often the content of a row, in the order of time within a batch, differs from that of the row before. The state store
    must keep several columns (see with_rocks()).
    """
    ship(pages.sparkSession)
    rows = pages.where(F.col("url").isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select("url", F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.xxhash64(F.col(content)).alias("content"), F.col(time).alias("time"))
    return rows.groupBy("url").transformWithStateInPandas(Seen(forget_ms), SEEN, "append", "EventTime")


def documents_of_pages(links: DataFrame, documents: DataFrame, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Every row of a stream of links (page_id, href, asked) with the documents (doc_href, body, got) that arrive within a time after it, or null.

    Both sides have watermarks, so a link is kept until its time is over and is then written without a document. Rows without a href meet nothing,
    but their times count: the keys are never null, as Catalyst would drop documents with a null key before the watermark sees them.
    """
    key = lambda c, alone: F.coalesce(F.concat(F.lit("="), c), F.lit(alone))
    left, right = links.withColumn("_asked_for", key("href", "<")).withWatermark("asked", delay), documents.withColumn("_given_for", key("doc_href", ">")).withWatermark("got", delay)
    near = (F.col("_asked_for") == F.col("_given_for")) & (F.col("got") >= F.col("asked")) & (F.col("got") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "leftOuter").drop("_asked_for", "_given_for")


def with_rocks(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query whose state needs RocksDB, and leaves the session's setting as it was."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(_STORE, before)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, over the progress that the query still holds."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def drained(stream: DataFrame, mode: str = "append", rocks: bool = False) -> tuple[DataFrame, StreamingQuery]:
    """Works off all that a stream has, batch by batch, and returns the rows that were written, with the batch's number, and the query."""
    spark, folder = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")  # the same folder when a batch runs again

    def start() -> StreamingQuery:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()

    query = with_rocks(spark, start) if rocks else start()
    query.awaitTermination()
    schema = StructType([*stream.schema, StructField("_batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{folder}/rows/batch=*"), query


def replayed(rows: DataFrame, time: str, batches: int) -> DataFrame:
    """A table as a stream of so many micro-batches in the order of a time, cut at quantiles of it."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ends = rows.select(F.percentile_approx(at, [k / batches for k in range(1, batches)], 10_000).alias("e")).first().e or [] if batches > 1 else []
    part = sum((F.when(at > e, 1).otherwise(0) for e in ends), F.lit(0))
    for k in range(len(ends) + 1):  # a file source takes files by their age
        rows.where(F.coalesce(part, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
