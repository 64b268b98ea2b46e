"""Tables in the folder that the driver and all executors share, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir; its tables are done with when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = _folders.setdefault("", tempfile.mkdtemp(prefix="metaloom-"))  # one machine
    return _folders.setdefault(base, f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The tables that one call writes; those of another call, in another thread too, are apart."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[str, DataFrame]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """Writes the rows and reads them again, which forgets the plan behind them."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, found))
        return found

    def release(self, *keep: DataFrame) -> None:
        """Deletes the tables but for those in keep (as cut() returned them)."""
        for path, df in self.tables:
            if not any(df is k for k in keep):
                delete(self.spark, path)
        self.tables = [(path, df) for path, df in self.tables if any(df is k for k in keep)]
