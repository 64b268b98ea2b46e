"""Sends the package to executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; the driver serves the archive to executors, also to those that start later."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="metaloom-"), "metaloom-package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
