"""A cache of pages that grows by merging: one answer for each URL, in buckets of which a merge rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import urls
from metaloom.functions.ship import ship

#: Buckets of a new cache; a bucket should have some hundred MB, so a cache of 100 TB wants a few hundred thousand.
BUCKETS = 256
SCHEMA = "url string, html string, final_url string, status int, content_type string, redirects array<struct<from:string,to:string,status:int>>, fetched_at timestamp"
_COLUMNS = ["url", "html", "final_url", "status", "content_type", "redirects", "fetched_at"]


class PageCache:
    """A folder of Parquet files, a directory for each bucket of URLs.

    put() may run again with the same rows, whole or after a failure: the newest answer of a URL stays (by fetched_at, nulls oldest; ties: the greatest
    hash of the row), so the result is the same. One put() at a time; readers that began before it may have to read again. The number of buckets belongs
    to the folder: give the same number each time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _all(self) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], f"{SCHEMA}, bucket int")
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(self.folder)

    def rows(self) -> DataFrame:
        """All entries (SCHEMA)."""
        return self._all().drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int").alias("bucket")

    def put(self, fresh: DataFrame) -> int:
        """Merges answers (columns of SCHEMA, missing ones are null; see fetch.cache_rows) and returns how many buckets were rewritten.

        URLs are compared as normalised; rows whose URL can't be are left out. A bucket is a task, which reads and sorts its own files only.
        """
        ship(self.spark)
        kinds = dict(zip(_COLUMNS, [f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema], strict=True))
        has = set(fresh.columns)
        given = fresh.select(*[(F.col(c) if c in has else F.lit(None)).cast(kinds[c]).alias(c) for c in _COLUMNS]).withColumn("url", urls.normalize_url("url")).where("url IS NOT NULL")
        given = given.select("*", self._bucket())
        touched = [r.bucket for r in given.select("bucket").distinct().collect()]  # numbers of buckets
        if not touched:
            return 0
        old = self._all()
        # A join instead of a list of numbers prunes directories while it runs, however many are touched.
        wanted = given.select("bucket").distinct()
        old = old.join(F.broadcast(wanted), "bucket", "left_semi").select(*_COLUMNS, "bucket")
        order = F.struct(F.col("fetched_at").isNotNull(), "fetched_at", F.xxhash64(*[c for c in _COLUMNS if c != "url"]))
        newest = old.unionByName(given).repartition(min(len(touched), 10_000), "bucket").groupBy("bucket", "url").agg(F.max_by(F.struct(*[c for c in _COLUMNS if c != "url"]), order).alias("x"))
        made = newest.select("url", *[F.col("x")[c].alias(c) for c in _COLUMNS if c != "url"], "bucket").sortWithinPartitions("bucket")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)
        return len(touched)
