"""Document fingerprints (operator 9): a homomorphic multiset hash of paragraphs.

A paragraph (line) maps to a wide vector of two sections: ``STRONG`` 64-bit numbers from an extendable hash
of the whole paragraph, and ``LANES`` 32-bit numbers, each the signed count of those of its 12-byte windows that
hash to the lane (a shorter paragraph has one padded window). A document's fingerprint is the sum of its
paragraphs' vectors, modulo 2^64 and 2^32. So it doesn't depend on the order of paragraphs, paragraphs can be
inserted and deleted by adding and subtracting their vectors, and equal multisets have equal fingerprints, while
unequal ones agree with a chance of about 2^-(64 * STRONG). The lanes are a linear sketch: the cosine of two
documents' lanes estimates that of their window counts, the likeness (1 for equal fingerprints, 0 at least).

Nulls count as empty texts, which are one empty paragraph. Rows that share a doc_id follow each other by the hash of
their text; a null doc_id comes last. An empty table gives none. Other columns of docs don't count.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.batches import pieces
from metaloom.functions.ship import ship
from metaloom.llm.common import BATCH_BYTES, BATCH_ROWS, map_rows, table

STRONG, LANES, WINDOW = 16, 256, 12
#: Rows of one range of doc_ids; a range is a task, which sorts outside memory and holds one row at a time.
RANGE_ROWS = 4000
#: Tasks that a stage can have; beyond as many ranges, they hold more rows, which takes time but no memory.
MOST_TASKS = 100_000
#: Sampled ids for each range, which ends follow.
SAMPLED = 30
_BLOCK, _CELLS, _NULL = 1 << 22, 1_000_000_000, -1e300


class Fingerprint:
    """A sum of paragraphs' vectors."""

    __slots__ = ("lanes", "strong")

    def __init__(self, strong: np.ndarray, lanes: np.ndarray):
        self.strong, self.lanes = strong, lanes

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong + other.strong, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.strong - other.strong, self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.strong == other.strong).all() and (self.lanes == other.lanes).all())

    __hash__ = None

    def written(self) -> str:
        return base64.b64encode(self.strong.tobytes() + self.lanes.tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        a, b = self.lanes.view(np.int32).astype(np.float64), other.lanes.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def read(text: str) -> Fingerprint:
    raw = base64.b64decode(text)
    return Fingerprint(np.frombuffer(raw[: 8 * STRONG], np.uint64).copy(), np.frombuffer(raw[8 * STRONG :], np.uint32).copy())


def of(text: str | None) -> Fingerprint:
    """The fingerprint of a whole text."""
    raw = (text or "").encode()
    paragraphs = raw.split(b"\n")
    strong = np.frombuffer(b"".join([hashlib.shake_256(p).digest(8 * STRONG) for p in paragraphs]), np.uint64).reshape(-1, STRONG).sum(0, dtype=np.uint64)
    counts = np.zeros(2 * LANES, np.int64)
    short = b"".join([p.ljust(WINDOW, b"\0") for p in paragraphs if 0 < len(p) < WINDOW])
    if short:
        counts += _cells(np.frombuffer(short, "<u8,<u4"))
    for start in range(0, max(0, len(raw) - WINDOW + 1), _BLOCK):
        part = raw[start : start + _BLOCK + WINDOW - 1]
        n = len(part) - WINDOW + 1
        low = np.empty(n, np.uint64)
        high = np.empty(n, np.uint32)
        for k in range(8):
            low[k::8] = np.frombuffer(part, "<u8", (len(part) - k) // 8, k)[: len(low[k::8])]
        for k in range(4):
            high[k::4] = np.frombuffer(part, "<u4", (len(part) - k - 8) // 4, k + 8)[: len(high[k::4])]
        place = _places(low, high)
        if len(paragraphs) > 1:
            breaks = np.concatenate(([0], np.cumsum(np.frombuffer(part, np.uint8) == 10)))
            place = place[breaks[WINDOW:] == breaks[:-WINDOW]]
        counts += np.bincount(place, minlength=2 * LANES)
    return Fingerprint(strong, (counts[::2] - counts[1::2]).astype(np.uint32))


def _places(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += high * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - (2 * LANES - 1).bit_length())).astype(np.int64)


def _cells(windows: np.ndarray) -> np.ndarray:
    return np.bincount(_places(windows["f0"], windows["f1"]), minlength=2 * LANES)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and fingerprint of every row of docs."""

    def make():
        return lambda keys, texts: [keys, [of(t).written() for t in texts]]

    return map_rows(docs.select(id_column, text_column), make, f"{id_column} {docs.schema[id_column].dataType.simpleString()}, fingerprint string")


def edit(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def dealt(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """docs (doc_id, text) with the order of rows of one id, and the range of descending doc_ids; and the ranges that have rows, in order.

    Ranges hold about RANGE_ROWS rows. Their ends are quantiles of ids that a hash samples, SAMPLED for each range, as
    Spark's own range partitioning takes them, but here the same whenever a task runs again. An id (or null) with the rows of several
    ranges is cut by its order, so only rows equal in id and text always share a range. The driver sees the sample and the ranges' numbers.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("order"), "text")
    n = docs.count()
    parts = max(1, min(MOST_TASKS, n // RANGE_ROWS))
    if parts == 1:
        return rows.withColumn("range", F.lit(0).cast("bigint")), [0] if n else []
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(_NULL))
    share = min(1.0, SAMPLED * parts / n)
    taken = rows.where(F.pmod(F.xxhash64("doc_id", "order"), F.lit(_CELLS)) < int(share * _CELLS))
    # Equal rows are sampled together, so they are counted before the driver sees them.
    sample = taken.groupBy(at.alias("at"), "order").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("at")
    value, until = sample["at"].to_numpy(np.float64), np.cumsum(sample["n"].to_numpy(np.int64))
    ends = value[np.searchsorted(until, np.linspace(0, until[-1] - 1, parts + 1).astype(np.int64)[1:-1], "right")] if len(value) else value
    cuts, counts = np.unique(ends, return_counts=True)
    deal = Bucketizer(splits=[float("-inf"), *cuts.tolist(), float("inf")], inputCol="at", outputCol="bucket")
    rows = deal.transform(rows.withColumn("at", at))
    # The rows of an id that is an end k times over are the last of its range in descending order; they are cut into 2k.
    hot = [(float(i + 1), float(c), int(2 * k)) for i, (c, k) in enumerate(zip(cuts, counts, strict=True)) if k > 1]
    width = max([2, *(k + 1 for *_, k in hot)])
    place = F.lit(0)
    if hot:
        known = F.broadcast(docs.sparkSession.createDataFrame(hot, "bucket double, _at double, _k bigint"))  # fewer than ranges
        rows = rows.join(known, "bucket", "left")
        sub = F.floor((F.col("order") / float(1 << 63) + 1) / 2 * F.col("_k"))
        place = F.when(F.col("at") == F.col("_at"), 1 + F.least(sub, F.col("_k") - 1)).otherwise(0)
    rows = rows.withColumn("range", (place - F.col("bucket").cast("bigint") * width).cast("bigint")).select("doc_id", "order", "text", "range")
    return rows, sorted(r.range for r in rows.select("range").distinct().collect())


def edited(docs: DataFrame) -> DataFrame:
    """The fingerprint of every row of docs (doc_id, text), and of its text edited with the next row's by descending doc_id.

    Each range is a task of its own, which sorts and streams it and knows the next row of every row but its last; first and last rows of
    the ranges are read from the same shuffle once more, and an aggregation of these few gives each last row the first of the next range.
    """
    ship(docs.sparkSession)
    rows, ranges = dealt(docs)
    if not ranges:
        return docs.sparkSession.createDataFrame([], _RESULT)
    n = len(ranges)  # at most about twice MOST_TASKS
    known = F.broadcast(docs.sparkSession.createDataFrame([(r, i) for i, r in enumerate(ranges)], "range bigint, i int"))
    # The number of a range is the number of its task; a hash of it would put several ranges into one.
    ordered = rows.join(known, "range").repartitionById(n, "i").sortWithinPartitions(F.col("doc_id").desc(), "order").select("i", "doc_id", "text")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in pieces(whole, BATCH_ROWS, BATCH_BYTES):
                out = []
                for part, key, text in zip(*(batch.column(c).to_pylist() for c in ("i", "doc_id", "text")), strict=True):
                    now = (part, key, text or "", of(text))
                    if held and held[0] == part:
                        out.append(_made(held[1], held[2], held[3], now[2], now[3]))
                    held = now
                if out:
                    yield _batch(out)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last row of each range, under the range's number; the first is meant for the range before."""
        held = None

        def one(i: int, first: bool, key: int | None, text: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((i, first, key, text), _ENDS.types, strict=True)], schema=_ENDS)

        for whole in batches:
            for batch in pieces(whole, BATCH_ROWS, BATCH_BYTES):
                parts, keys, texts = batch.column("i").to_pylist(), batch.column("doc_id"), batch.column("text")
                for j in [j for j, part in enumerate(parts) if part != (parts[j - 1] if j else held and held[0])]:
                    last = (parts[j - 1], keys[j - 1].as_py(), texts[j - 1].as_py()) if j else held
                    if last:
                        yield one(last[0], False, *last[1:])
                    yield one((parts[j] - 1) % n, True, keys[j].as_py(), texts[j].as_py())
                held = (parts[-1], keys[-1].as_py(), texts[-1].as_py())
        if held:
            yield one(held[0], False, *held[1:])

    edges = ordered.mapInArrow(ends, "i bigint, first boolean, doc_id bigint, text string")
    own, theirs = (lambda c: F.max(F.when(~F.col("first"), F.col(c))).alias(c)), F.max(F.when(F.col("first"), F.col("text"))).alias("following")
    lasts = edges.groupBy("i").agg(own("doc_id"), own("text"), theirs).drop("i")  # two rows for each i

    def outer():
        def run(keys, texts, following):
            out = [_made(k, t or "", of(t), f or "", of(f)) for k, t, f in zip(keys, texts, following, strict=True)]
            return list(zip(*out, strict=True))

        return run

    return ordered.mapInArrow(inner, _RESULT).unionByName(map_rows(lasts, outer, _RESULT))


def _made(key: int | None, text: str, own: Fingerprint, following: str, theirs: Fingerprint) -> tuple:
    made = edit(text, following)
    changed = of(made)
    return key, len(text), hashlib.sha256(made.encode()).hexdigest(), own.written(), changed.written(), own.likeness(changed), own.likeness(theirs)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_ENDS = pa.schema([("i", pa.int64()), ("first", pa.bool_()), ("doc_id", pa.int64()), ("text", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
