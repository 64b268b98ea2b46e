"""Benchmark decontamination (operator 13): suffix arrays over the training text, searched for every test suffix.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A task cuts its documents into shards of about
``SHARD_BYTES`` and sorts all suffixes of a shard's words (prefix doubling) as deep as the longest test text. Every suffix of every test text is
binary-searched in every shard, word by word: the interval of equal suffixes narrows until it is empty, which gives the longest verbatim
match and where it stands. Where a test text has a window of ``WINDOW`` words (a shorter text is one window), the interval at that depth
holds all occurrences of it, and their words are hit. A match never leaves a document. Documents aren't shuffled; a very long one is
searched in slices that overlap by the longest test text, so memory follows the slice.

Words that no test text has share one sign and begin no suffix, as nothing can match them. Words are equal if their 64-bit hashes are.
Test texts are cut into segments of ``SEGMENT`` words that overlap so that each window stays whole, hashed by tasks, and go to the executors in
blocks of about ``BLOCK_WORDS`` words: one after another, each a pass over the documents, whose results are merged by document. So neither the driver
nor a task holds more than a block, however large the benchmark is. Windows of rows that share an item_id are one item's; a null
item_id counts as an item that is written as the empty string.

Null texts and texts without words have no words, as documents and as items. Rows that share a doc_id or are equal are judged
each for itself. Other columns don't count and stay where rows are filtered. Without items nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions.batches import pieces
from metaloom.functions.ship import ship
from metaloom.llm.common import cut, map_rows, mark, release, table
from metaloom.llm.words import hashed_words

WINDOW = 10
SHARD_ROWS, SHARD_BYTES, SLICE_WORDS = 10_000, 6 << 20, 1 << 20
SEGMENT, BLOCK_WORDS = 4096, 1 << 20
_INSIDE = np.array([48 <= i <= 57 or 97 <= i <= 122 or i >= 128 for i in range(256)])


class Tests:
    """A block of test texts: words as numbers from 1 on, 0 after each text, and all suffixes with what they need to match."""

    def __init__(self, segments: list[tuple[str, int, bytes]], window: int = WINDOW):
        """segments: item, place of the first word, and hashes of the words; one of fewer words than a window is a whole text."""
        texts = [np.frombuffer(words, np.uint64) for _, _, words in segments]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]))
        self.words = np.concatenate([np.zeros(1, np.int32), *(x for t in texts for x in (self.number(t), np.zeros(1, np.int32)))])
        self.depth = max([0, *map(len, texts)])
        self.names = [item for item, *_ in segments]
        at = 1
        starts, left, need, owner, offset = [], [], [], [], []
        for k, (t, (_, first, _)) in enumerate(zip(texts, segments, strict=True)):
            n = np.arange(len(t))
            starts.append(at + n)
            left.append(len(t) - n)
            short = len(t) < window
            need.append(np.where(n == 0, len(t), 0) if short else np.where(len(t) - n >= window, window, 0))
            owner.append(np.full(len(t), k))
            offset.append(first + n)
            at += len(t) + 1
        self.starts, self.left, self.need, self.owner, self.offset = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, left, need, owner, offset))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes; 0 for what no test text has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


class SuffixArray:
    """The suffixes of words that start with a number above 0, in the order of their first depth words (or what follows up to a 0)."""

    def __init__(self, words: np.ndarray, depth: int, largest: int):
        bits = max(1, int(largest).bit_length())
        known = max(1, min(depth, 62 // bits))
        self.words = np.concatenate((words, np.zeros(depth + known + 1, words.dtype)))
        at = np.flatnonzero(words)
        key = np.zeros(len(at), np.int64)
        for k in range(known):
            key = key << bits | self.words[at + k]
        by = np.argsort(key)
        self.order, key = at[by], key[by]
        rank = np.zeros(len(self.words) + depth, np.int64)
        rank[self.order] = _groups(key)
        while known < depth:
            of = rank[self.order]
            same = np.zeros(len(of) + 1, bool)
            same[1:-1] = of[1:] == of[:-1]
            slots = np.flatnonzero(same[1:] | same[:-1])
            if not len(slots):
                break
            # The rank is the group's first slot, so sorting only what is tied puts everything back into the same slots.
            tied = self.order[slots]
            key = rank[tied] << 31 | rank[tied + known]
            by = np.argsort(key)
            self.order[slots] = tied[by]
            fresh = rank.copy()
            fresh[tied[by]] = slots[_groups(key[by]) - 1] + 1
            rank, known = fresh, known * 2

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of intervals of suffixes whose word at a depth is the wanted one."""
        return self._bound(lo, hi, depth, wanted), self._bound(lo, hi, depth, wanted + 1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            below = self.words[self.order[middle] + depth] < wanted[open_]
            lo[open_[below]] = middle[below] + 1
            hi[open_[~below]] = middle[~below]
        return lo


def _groups(key: np.ndarray) -> np.ndarray:
    """Of sorted keys: the place from 1 of the first that equals each."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(1, len(key) + 1), 0))


class Found:
    """What a search of all test suffixes gives: the longest match and a place of it, and the interval at the depth of the window."""

    def __init__(self, words: np.ndarray, tests: Tests):
        self.array = array = SuffixArray(words, tests.depth, len(tests.vocabulary))
        n = len(tests.starts)
        self.length, self.place = np.zeros(n, np.int64), np.full(n, -1)
        self.lo, self.hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, len(array.order))
        for depth in range(tests.depth):
            inside = tests.left[alive] > depth
            alive, lo, hi = alive[inside], lo[inside], hi[inside]
            lo, hi = array.narrowed(lo, hi, depth, tests.words[tests.starts[alive] + depth])
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
            if not len(alive):
                break
            self.length[alive], self.place[alive] = depth + 1, array.order[lo]
            full = tests.need[alive] == depth + 1
            self.lo[alive[full]], self.hi[alive[full]] = lo[full], hi[full]

    def windows(self, tests: Tests) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Places, number of words and owners of each distinct window that occurs."""
        hit = np.flatnonzero(self.hi > self.lo)
        by = hit[np.lexsort((tests.owner[hit], tests.need[hit], self.lo[hit]))]
        starts = np.flatnonzero(np.diff(self.lo[by], prepend=-1) | np.diff(tests.need[by], prepend=-1))
        for same in np.split(by, starts[1:]) if len(by) else ():
            q = same[0]
            yield self.array.order[self.lo[q] : self.hi[q]], int(tests.need[q]), np.unique(tests.owner[same])


def _sequence(texts: list[str | None], tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as numbers with a 0 after each text, where each text starts in it, and the texts' numbers of words."""
    raw = [(t or "").encode() for t in texts]
    hashes, places = hashed_words(b"\0".join(raw).lower(), _INSIDE)
    ends = np.cumsum([len(r) + 1 for r in raw])
    until = np.searchsorted(places, ends)
    counts = np.diff(until, prepend=0)
    words = np.zeros(len(hashes) + len(raw), np.int32)
    words[np.arange(len(hashes)) + np.repeat(np.arange(len(raw)), counts)] = tests.number(hashes)
    return words, until - counts + np.arange(len(raw)), counts


def searched(words: np.ndarray, tests: Tests) -> Iterator[tuple[int, int, Found]]:
    """(first, end, what is found) of each slice; places count from first, those from end on belong to the next slice."""
    for first in range(0, len(words), SLICE_WORDS):
        yield first, min(len(words), first + SLICE_WORDS), Found(words[first : first + SLICE_WORDS + tests.depth], tests)


def hits(texts: list[str | None], tests: Tests) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text: its number of words, what is hit as starts and ends of ranges of words, and the items whose windows occur."""
    words, begins, counts = _sequence(texts, tests)
    deltas = np.zeros(len(words) + tests.depth + 1, np.int64)
    owners: dict[int, set[str]] = {}
    for first, end, found in searched(words, tests):
        for places, need, who in found.windows(tests):
            places = places[places < end - first] + first
            deltas[places] += 1  # places are distinct
            deltas[places + need] -= 1
            for doc in np.unique(np.searchsorted(begins, places, "right") - 1).tolist():
                owners.setdefault(doc, set()).update(tests.names[k] for k in who)
    ranges: list[list[int]] = [[] for _ in texts]
    if owners:
        edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(deltas) > 0))))
        doc = np.searchsorted(begins, edges[::2], "right") - 1
        for d, a, b in zip(doc.tolist(), (edges[::2] - begins[doc]).tolist(), (edges[1::2] - begins[doc]).tolist(), strict=True):
            ranges[d] += [a, b]
    return counts.tolist(), ranges, [sorted(owners.get(k, ())) for k in range(len(texts))]


def segments(tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, first and words of every segment of tests (item_id, text); equal ones once."""

    def make():
        def run(items, texts):
            out: list[tuple] = []
            for item, text in zip(items, texts, strict=True):
                hashes, _ = hashed_words((text or "").encode().lower(), _INSIDE)
                n = len(hashes)
                for first in range(0, max(1, n - window + 1) if n else 0, SEGMENT):
                    out.append((item, first, hashes[first : first + SEGMENT + window - 1].tobytes()))
            return list(zip(*out, strict=True)) if out else [[], [], []]

        return run

    named = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return map_rows(named, make, "item string, first bigint, words binary").dropDuplicates()


def planned(tests: DataFrame, window: int = WINDOW) -> tuple[DataFrame, int]:
    """The segments of tests, written out, and the number of blocks that they make, at least one."""
    made = cut(segments(tests, window))
    total = (made.agg(F.sum(F.length("words"))).first()[0] or 0) // 8
    return made, 1 if total <= BLOCK_WORDS else -(-2 * total // BLOCK_WORDS)


def block(made: DataFrame, number: int, n: int, window: int = WINDOW) -> Tests:
    """One of n blocks, of BLOCK_WORDS words at most if n is 1, else of half as many in the mean."""
    rows = made.where(F.pmod(F.xxhash64("item", "first", "words"), F.lit(n)) == number) if n > 1 else made
    return Tests(sorted(map(tuple, rows.collect())), window)


_HITS = "doc_id bigint, t1 bigint, t2 bigint, n_words bigint, ranges array<bigint>, items array<string>"


def occurrences(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, ranges (starts and ends of runs of hit words) and items (whose windows occur) of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    since = mark()
    made, n = planned(tests, window)
    found = []
    for b in range(n):
        shared = spark.sparkContext.broadcast(block(made, b, n, window))
        found.append(_by_shard(rows, lambda texts, shared=shared: hits(texts, shared.value)))
        if n > 1:
            found[b] = cut(found[b].where(F.size("items") > 0).drop("n_words").dropDuplicates(["doc_id", "t1", "t2"]) if b else found[b])
    release(spark, since, *found)
    base, more = found[0], found[1:]
    if not more:
        return base.drop("t1", "t2")
    parts = more[0]
    for part in more[1:]:
        parts = parts.unionByName(part)
    parts = parts.groupBy("doc_id", "t1", "t2").agg(F.flatten(F.collect_list("ranges")).alias("_more"), F.flatten(F.collect_list("items")).alias("_also"))  # a row for each block
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_more", "_also")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    joined = base.join(parts.hint("merge"), same, "left")
    both = joined.select("doc_id", "n_words", F.concat("ranges", F.coalesce("_more", F.array().cast("array<bigint>"))).alias("ranges"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_also", F.array().cast("array<string>"))))).alias("items"))
    return map_rows(both, lambda: lambda keys, n, ranges, items: [keys, n, [_union(r) for r in ranges], items], "doc_id bigint, n_words bigint, ranges array<bigint>, items array<string>")


def _union(ranges: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _by_shard(rows: DataFrame, of) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "t1", "t2", "n_words")] + [("ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, SHARD_ROWS, SHARD_BYTES):
                made = of(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(pa.int64()) for c in ("doc_id", "t1", "t2")] + [pa.array(x, schema.field(i + 3).type) for i, x in enumerate(made)], schema=schema)

    return rows.mapInArrow(run, _HITS)


def decontaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs (text, more) in which no window of tests occurs, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    since = mark()
    made, n = planned(tests, window)
    for b in range(n):
        docs = _clean(docs, spark.sparkContext.broadcast(block(made, b, n, window)))
    release(spark, since)
    return docs


def _clean(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, SHARD_ROWS, SHARD_BYTES):
                _, _, items = hits(batch.column("text").to_pylist(), shared.value)
                yield batch.filter(pa.array([not x for x in items], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """item, first (place of the suffix's first word), n_words of its longest verbatim match in docs, and the doc_id and word at which one stands.

    Suffixes without a match have no row. A match is as long as a segment at most. A task keeps the best of its shards only.
    """
    spark = docs.sparkSession
    ship(spark)
    since = mark()
    made, n = planned(tests)
    parts = [_longest(docs.select("doc_id", "text"), spark.sparkContext.broadcast(block(made, b, n))) for b in range(n)]
    release(spark, since)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = found.groupBy("item", "first").agg(F.max(F.struct("n_words", "doc_id", "place")).alias("at"))
    return best.select("item", "first", "at.n_words", "at.doc_id", "at.place")


def _longest(docs: DataFrame, shared) -> DataFrame:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared.value
        length, best = np.zeros(len(tests.starts), np.int64), {}
        for whole in batches:
            for batch in pieces(whole, SHARD_ROWS, SHARD_BYTES):
                keys = batch.column("doc_id").to_pylist()
                words, begins, _ = _sequence(batch.column("text").to_pylist(), tests)
                for first, _, found in searched(words, tests):
                    for q in np.flatnonzero(found.length > length).tolist():
                        at = int(found.place[q]) + first
                        doc = int(np.searchsorted(begins, at, "right")) - 1
                        best[q] = (keys[doc], at - int(begins[doc]))
                    length = np.maximum(length, found.length)
        rows = [(tests.names[tests.owner[q]], int(tests.offset[q]), int(length[q]), *at) for q, at in best.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["item", "first", "n_words", "doc_id", "place"])

    return docs.mapInArrow(run, "item string, first bigint, n_words bigint, doc_id bigint, place bigint")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda sum_, x: x - sum_)  # ends less starts
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
