"""Pages as a stream: the same records, as every row is worked on alone and nothing shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from metaloom.plans.api import Engine

SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of pages as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_records(pages: DataFrame, folder: str, checkpoint: str, engine: Engine | None = None, available_now: bool = True) -> StreamingQuery:
    """Parses the stream and appends its records as Parquet; files appear exactly once, by the sink's log."""
    writer = (engine or Engine()).parse(pages).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(folder)


def once_by_url(pages: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Drops repeated URLs within a delay; the state is bounded by the watermark."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
