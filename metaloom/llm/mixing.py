"""Mixing sources to target weights (operator 8): Pareto order sampling.

Sources in order of code points, null last, have weights that repeat; together they get a share of all words. No target
exceeds ``MOST`` times its source's words; what lies above is shared among the others by weight until none is above.
Every document of a source is taken whole as often as its target holds all words of the source. What that leaves of the target, its rest, is
sampled with unequal probabilities: a document of n words has the inclusion probability p = min(1, a * n^POWER), where a is such that the
words expected of the source are its rest. Documents at p = 1 get one more copy for certain and take no part in the sample. The others are ranked by
Pareto's number, random odds u / (1 - u) divided by the inclusion odds p / (1 - p), and taken in that order while the wanted number of words
isn't passed: the sample's size is fixed in words. The document at which the words would be passed is skipped, and ``ROUNDS`` further passes go
on after it with the documents that still fit. So each document is included with about its p, but for one bias: a document whose size is a large part of
what its source is to get passes the end more often and is taken less, and small ones fill what it leaves. a follows from the numbers of documents of each
size, of which a source has as many as its texts have lengths.

u is a hash of doc_id and text, so reruns agree. The place in the order at which a source's words are reached is found by sums
over ranges of the Pareto number, as many as rows demand, then within one range of each source; only this place is
remembered, no table of rows is written again. So a source with a third of all rows is never in one task. Null and empty texts have size 0
and are taken 0 times; repeated rows that agree in id and text share a place and are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloom.llm.common import WORD, before, buckets_for, cut, mark, numbered, ranked, release, table

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
ROUNDS = 3
#: How a document's chance grows with its words: 0 for equal chances, 1 for chances in proportion.
POWER = 0.5
#: Sources up to which their table is sent to all executors.
FEW_SOURCES = 10_000
#: Columns that mix() adds; the caller's columns of these names are left out.
ADDED = ("size", "source_size", "target", "chance", "copies", "taken")
_PLACE = "struct<t:double,r:bigint,size:bigint>"
_ROUND = f"struct<lo:{_PLACE},left:double,edge:{_PLACE},k:bigint>"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """source, source_size and target of every source of sizes (source, source_size), and the number of sources."""
    listed = numbered(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    listed = cut(listed.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size")))
    n, total, all_weights = listed.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("_w")).first()
    if not n:
        return listed.select("source", "source_size", F.col("_cap").alias("target")), 0
    wanted, level, capped = share * (total or 0), 0.0, -1
    level = wanted / all_weights
    while True:  # the level only rises, and with it the number of sources at their cap
        full = F.col("_w") * level >= F.col("_cap")
        now, at_cap, free = listed.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if now == capped or not free:
            break
        capped, level = now, (wanted - (at_cap or 0.0)) / free
    target = F.least(F.col("_w") * level, F.col("_cap")) if free else F.col("_cap")
    return listed.select("source", "source_size", target.cast("double").alias("target")), n


def chances(sizes: DataFrame) -> DataFrame:
    """_key, _a and _sure (words of the documents that are certain) from sizes (_key, _rest, size, n), with one row for each size above 0."""
    weight = F.pow(F.col("size").cast("double"), F.lit(POWER))
    words, part = F.col("n") * F.col("size"), Window.partitionBy("_key")
    larger = F.coalesce(F.sum(words).over(part.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum(words * weight).over(part.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    # The largest documents are certain down to the size at which the rest, shared among all from there, leaves that size below 1.
    tried = sizes.withColumns({"_w": weight, "_sure": larger, "_all": others}).withColumn("_a", (F.col("_rest") - F.col("_sure")) / F.col("_all"))
    return tried.groupBy("_key").agg(F.max_by(F.struct("_a", "_sure"), F.when(F.col("_a") * F.col("_w") < 1, F.col("size"))).alias("x")).select("_key", "x._a", "x._sure")


def placed(docs: DataFrame, seed: int, weights, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their size, place and chance; and of each source its key and what is to be sampled. _more holds the caller's other columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = _others(docs)
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    rows = docs.select("doc_id", "source", *[F.struct(*more).alias("_more")] * bool(more), size, F.xxhash64("doc_id", F.xxhash64(text), F.lit(seed)).alias("_r"), F.monotonically_increasing_id().alias("_n"))
    rows = cut(rows)
    of_source, n = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    of_source = of_source.select(F.col("source").alias("_of"), F.xxhash64("source", F.isnull("source")).alias("_key"), "source_size", "target", whole.alias("_whole"))
    of_source = cut(of_source.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))))
    few = lambda df: F.broadcast(df) if n <= FEW_SOURCES else df
    same = F.col("source").eqNullSafe(F.col("_of"))
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).join(few(of_source.select("_of", "_key", "_rest")), same)
    told = chances(sizes.select("_key", "_rest", "size", "n"))
    of_source = cut(of_source.join(told, "_key", "left").withColumns({"_a": F.coalesce("_a", F.lit(0.0)), "_left": F.greatest(F.lit(0.0), F.col("_rest") - F.coalesce("_sure", F.lit(0)))}))
    rows = rows.join(few(of_source.drop("_rest", "_sure", "_left")), same).drop("_of")
    chance = F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("_a") * F.pow(F.col("size").cast("double"), F.lit(POWER)))).otherwise(0.0)
    rows = rows.withColumn("chance", chance).withColumn("_whole", F.col("_whole") + (F.col("chance") >= 1).cast("int")).drop("_a")
    u = (F.pmod("_r", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    pareto = u / (1 - u) * (1 - F.col("chance")) / F.greatest(F.col("chance"), F.lit(1e-12))
    buckets = buckets_for(rows.count())
    rows = rows.withColumn("_t", pareto / (1 + pareto)).withColumn("_bucket", F.least(F.floor(F.col("_t") * buckets), F.lit(buckets - 1)))
    rows = rows.withColumn("_place", F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"), "size").cast(_PLACE)).drop("_t", "_r")
    return cut(rows), of_source.select("_key", "_left", F.lit(None).cast(_PLACE).alias("_lo"), F.array().cast(f"array<{_ROUND}>").alias("_rounds"))


def _others(docs: DataFrame) -> list[str]:
    """The caller's columns that are only kept."""
    return [c for c in docs.columns if c.lower() not in ("doc_id", "source", "text", *ADDED)]


def _next(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One pass: from each source's last place on, documents that fit are taken in order until the words would be passed."""
    side = _small(state)
    open_ = (F.col("size") > 0) & (F.col("chance") < 1) & (F.col("size") <= F.col("_left")) & (F.col("_lo").isNull() | (F.col("_place") > F.col("_lo")))
    fits = rows.join(side.drop("_rounds"), "_key").where(open_)
    sums = before(fits.groupBy("_key", "_bucket").agg(F.sum("size").alias("_s"), F.first("_left").alias("_left")), ["_key"], "_bucket", "_s", "_before")
    ranges = sums.where(F.col("_before") + F.col("_s") > F.col("_left")).groupBy("_key").agg(F.min(F.struct("_bucket", "_before")).alias("_e"))
    # The range of each source in which its words are reached, about BUCKET_ROWS rows.
    near = fits.join(_small(ranges.select("_key", "_e._bucket", "_e._before")), ["_key", "_bucket"])
    same = near.groupBy("_key", "_place").agg(F.count(F.lit(1)).alias("_m"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
    words = F.col("_m") * F.col("_place.size")
    run = F.col("_before") + F.coalesce(F.sum(words).over(Window.partitionBy("_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = same.withColumn("_run", run).where(F.col("_run") + words > F.col("_left")).groupBy("_key").agg(F.min(F.struct("_place", "_run")).alias("_e"))
    found = state.join(ends, "_key", "left")
    k = F.floor((F.col("_left") - F.col("_e._run")) / F.col("_e._place.size"))
    left = F.when(F.col("_e").isNull(), 0.0).otherwise(F.col("_left") - F.col("_e._run") - k * F.col("_e._place.size"))
    done = F.struct(F.col("_lo").alias("lo"), F.col("_left").alias("left"), F.col("_e._place").alias("edge"), k.cast("bigint").alias("k")).cast(_ROUND)
    return cut(found.select("_key", left.alias("_left"), F.coalesce("_e._place", "_lo").alias("_lo"), F.concat("_rounds", F.array(done)).alias("_rounds")))


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds size, source_size, target, chance (of one more copy than all have), copies and taken to docs (doc_id, source, text, more).

    The text and columns of these names are dropped; other columns may have any names.
    """
    since = mark()
    rows, state = placed(docs, seed, weights, share, most)
    for _ in range(1 + ROUNDS):
        state = _next(rows, state)
    release(docs.sparkSession, since, rows, state)
    side = state.select("_key", "_rounds")
    told = rows.join(F.broadcast(side) if state.count() <= FEW_SOURCES else side, "_key")
    place = F.col("_place")
    inside = lambda x: (F.col("size") > 0) & (F.col("chance") < 1) & (F.col("size") <= x.left) & (x.lo.isNull() | (place > x.lo)) & (x.edge.isNull() | (place < x.edge))
    at_edge = F.get(F.filter("_rounds", lambda x: x.edge == place), F.lit(0))
    told = told.withColumns({"_in": F.coalesce(F.exists("_rounds", inside), F.lit(False)), "_k": at_edge.k}).drop("_rounds")
    edge = ranked(told.where("_k IS NOT NULL"), ["_key", "_place"], ["_n"], "_rank", 64).withColumn("_in", F.col("_rank") < F.col("_k")).drop("_rank")
    every = told.where("_k IS NULL").unionByName(edge)
    copies = F.col("_whole") + F.col("_in").cast("int")
    every = every.withColumn("copies", copies).withColumn("taken", (F.col("size") * copies).cast("long"))
    more = _others(docs)
    return every.select(*[F.col("_more")[c].alias(c) if c in more else F.col(c) for c in docs.columns if c in more or c in ("doc_id", "source")], *ADDED)


def _small(state: DataFrame) -> DataFrame:
    state = cut(state)
    return F.broadcast(state) if state.count() <= FEW_SOURCES else state


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Of rows equal in id, source and text one stands for all."""
    since = mark()
    same = [F.col("doc_id"), F.isnull("doc_id"), F.col("source"), F.isnull("source"), F.col("text"), F.isnull("text")]
    hashes = [F.xxhash64(*same).alias("_h1"), F.xxhash64(F.lit(1), *same).alias("_h2")]
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), *hashes)  # so the caller's columns may have any names
    chosen = mix(docs.select("doc_id", "source", "text", *hashes), **options)
    copies = cut(chosen.groupBy("_h1", "_h2").agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    release(docs.sparkSession, since, copies)
    joined = keyed.join(copies, ["_h1", "_h2"])
    once = joined
    if not copies.where("_rows > 1").isEmpty():
        once = joined.where("_rows = 1").unionByName(joined.where("_rows > 1").dropDuplicates(["_h1", "_h2"]))
    return once.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = mark()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = cut(mix(docs).select("doc_id", "size", "source_size", "target", "taken"))
    release(spark, since, found)
    return found
