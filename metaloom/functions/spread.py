"""Rows dealt to tasks by their number, for tables whose rows are small and cost much."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, per_task: int = 5_000, enough: int = 64, most: int = 20_000) -> DataFrame:
    """The rows in tasks of about per_task; where that makes more tasks than enough, they grow to most rows, as a task has costs of its own.

    Spark splits files by their bytes, so a few MB are one task even if a page is made of each row. Call it on narrow rows, before pages are
    made of them; the rows are counted first.
    """
    n = rows.count()
    tasks = max(min(-(-n // per_task), enough), -(-n // most))
    return rows.repartition(tasks) if tasks > 1 else rows
