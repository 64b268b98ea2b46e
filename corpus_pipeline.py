"""The corpus pipeline: classify, deduplicate, redact, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents (COLUMNS); other columns of docs are left out at the first stage.
An empty table passes through every stage. Nulls in any column stay as they are unless a stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from metaloom.llm import bpe, mixing, neardup, pii, quality
from metaloom.llm.common import delete, mark, release, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL states these rows; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the folds that operator 6 may learn from.

    Null and empty texts are scored like any other, all alike; repeated rows are kept or dropped together.
    """
    model = quality.training_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(*COLUMNS), model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest doc_id, nulls last. Texts without words are no duplicates and stay."""
    return neardup.deduplicated(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place and counts n_chars anew. A null text stays null, as does its n_chars."""
    return pii.redacted(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights. Texts without words have no size and are dropped."""
    return mixing.mixed(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every row of the mix, copies included. A null text counts as empty."""
    return bpe.digest(docs.select("doc_id", "text"))


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("pii", redact), ("mix", mix), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder before the next reads it.

    Once it is written, what it was made from is deleted: only the last stage's input stays.
    """
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, since)
        if last:
            delete(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)
