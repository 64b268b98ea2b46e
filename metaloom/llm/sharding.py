"""Sharding (operator 10): balanced label propagation under the law `rows`.

Documents with equal texts are linked. Linked documents start evenly spread, and in each round every one looks up,
through a join with its group's counts, the shard that holds most of its group; moves between two shards are
accepted as swaps of equal numbers, plus as many as the target's quota has room for. Unlinked documents cut no edge
wherever they go, so they fill the shards to their quotas: the counts differ by one at most.

All of a group's documents in one shard wish the same, so rounds work on one row for each group and shard, with its count; a move
that its quota allows in part is cut there. How a group is shared out in the end is told to its rows by their rank in the group.
So a group's size costs nothing in a round, and no join or rank brings a group's rows into one task: ``HOT`` groups at most, those
that are larger than n / ``HOT`` rows, are told apart by a small table before anything is dealt by group.

An even start leaves a large group (more rows than ``SMALL`` and 1/``PIECES`` of a shard, or than a shard) without a majority, so room
decides: from the largest on, each goes whole to the shard that it fills most, and is cut only if no shard has room for all of it,
then into as few parts as there can be. Their number is bounded, so the driver plans them. The rounds then move the other groups
within the room that is left.

Slots number each shard's rows from 0. Null texts have size 1 and checksum 0 and are linked with each other, apart from the
empty text's. Rows that agree in all columns are interchangeable, and dealt
apart like any others. All of it is DataFrame operations on ids, sizes and hashes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import before, buckets_for, cut, mark, ranked, release, running, table

SHARDS, ROUNDS, PIECES, SMALL, HOT = 8, 6, 16, 64, 4096
#: row, a number that the written table has, tells equal rows apart, so that no bucket gets all of them.
_ORDER = ["doc_id", "text_crc32", "size", "g", "row"]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the hash of the text that links equal texts, and a number of the row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.concat(F.when(F.isnull("text"), F.lit("n")).otherwise(F.lit("t")), F.md5(text)).alias("g"), F.monotonically_increasing_id().alias("row"))


def planned(groups: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int, int]]:
    """(group, first rank, rank after the last, shard) for each part of large groups (group, rows); takes their rows off room."""
    parts = []
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        start = 0
        while start < n:
            fits = [j for j, r in enumerate(room) if r >= n - start]
            j = min(fits, key=lambda j: room[j]) if fits else max(range(len(room)), key=lambda j: room[j])
            end = min(n, start + room[j])
            parts.append((g, start, end, j))
            room[j] -= end - start
            start = end
    return parts


def dealt(shares: list[int]) -> Column:
    """The label of the row at _rank when label j takes shares[j] rows, one label after the other."""
    label = F.lit(len(shares) - 1)
    for j in reversed(range(len(shares))):
        label = F.when(F.col("_rank") < sum(shares[: j + 1]), F.lit(j)).otherwise(label)
    return label.cast("int")


def propagate(start: DataFrame, quotas: list[int], buckets: int, rounds: int = ROUNDS) -> DataFrame:
    """How many rows of each group go to each label, at most quotas[j] to label j; start and result have g, label and n.

    The driver sees the number of rows for each pair of shards.
    """
    shards, state = len(quotas), cut(start)
    for _ in range(rounds):
        liked = state.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "label").alias("tie"), "label")).alias("top")).select("g", F.col("top.label").alias("to"))
        wishes = cut(state.join(liked, "g"))
        flows = {(r.label, r.to): r.n for r in wishes.groupBy("label", "to").agg(F.sum("n").alias("n")).collect()}
        loads = [sum(c for (a, _), c in flows.items() if a == j) for j in range(shards)]
        quota = {}
        for j in range(shards):
            room = quotas[j] - loads[j]
            for i in range(shards):
                wish = flows.get((i, j), 0) if i != j else 0
                swap = min(wish, flows.get((j, i), 0))
                more = min(wish - swap, max(0, room))
                room -= more
                if swap + more:
                    quota[i, j] = swap + more
        if not quota:
            break
        allowed = F.coalesce(F.create_map(*[F.lit(x) for (i, j), c in quota.items() for x in (i * shards + j, c)])[F.col("label") * shards + F.col("to")], F.lit(0))
        movers = running(wishes.where("label <> to"), ["label", "to"], ["g"], F.col("n"), "_before", buckets)
        movers = movers.withColumn("_go", F.greatest(F.lit(0), F.least(F.col("n"), allowed - F.col("_before"))))
        gone = movers.select("g", F.col("to").alias("label"), F.col("_go").alias("n"))
        stay = movers.select("g", "label", (F.col("n") - F.col("_go")).alias("n"))
        every = wishes.where("label = to").select("g", "label", "n").unionByName(gone).unionByName(stay)
        state = cut(every.where("n > 0").groupBy("g", "label").agg(F.sum("n").alias("n")))
    return state


def shared_out(rows: DataFrame, parts: DataFrame, buckets: int) -> DataFrame:
    """Rows with the label that parts (g, label, n) gives their rank in their group; both have the same number for each group.

    Ranks are made in buckets, and the parts are joined to the buckets' counts, so that rows meet them without being dealt by group alone.
    """
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(*_ORDER), F.lit(buckets)))
    counts = before(dealt.groupBy("g", "_b").agg(F.count(F.lit(1)).alias("_n")), ["g"], "_b", "_n", "_start")
    ends = before(parts, ["g"], "label", "n", "_from").groupBy("g").agg(F.array_sort(F.collect_list(F.struct((F.col("_from") + F.col("n")).alias("end"), "label"))).alias("_ends"))
    told = counts.join(ends, "g").select("g", "_b", "_start", "_ends")
    inside = F.expr("row_number() OVER (PARTITION BY g, _b ORDER BY doc_id, text_crc32, size, row) - 1")
    placed = dealt.withColumn("_i", inside).join(told, ["g", "_b"]).withColumn("_rank", F.col("_start") + F.col("_i"))
    label = F.get(F.filter("_ends", lambda e: e.end > F.col("_rank")), F.lit(0)).label
    return placed.withColumn("label", label.cast("int")).select(*rows.columns, "label")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, g, shard and slot of every row of docs (doc_id, text)."""
    spark, since = docs.sparkSession, mark()
    rows = cut(described(docs))
    n = rows.count()
    buckets = buckets_for(n)
    quotas = [n // shards + (j < n % shards) for j in range(shards)]
    groups = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot = groups.where(F.col("n") > max(SMALL, n // HOT))  # fewer than HOT
    told = rows.join(F.broadcast(hot), "g", "left")
    others = told.where("n IS NULL").drop("n").join(groups.join(F.broadcast(hot.select("g")), "g", "left_anti"), "g", "left")
    joined = cut(told.where("n IS NOT NULL").unionByName(others))
    # Large groups: planned as wholes.
    most = min(max(SMALL, n // (shards * PIECES)), quotas[-1])
    room = list(quotas)
    plan = planned([(r.g, r.n) for r in groups.where(F.col("n") > most).collect()], room)
    listed = json.dumps([{"g": g, "label": j, "n": end - start} for g, start, end, j in plan])  # a literal, as rows from Python come as an RDD
    parts = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<g:string,label:int,n:bigint>>")))
    # The other groups: an even start, in proportion to the room, then rounds.
    linked = joined.where((F.col("n") > 1) & (F.col("n") <= most)).drop("n")
    m = linked.count()
    shares = [m * r // max(1, sum(room)) for r in room]
    for j in [j for j in range(shards) if shares[j] < room[j]][: m - sum(shares)]:
        shares[j] += 1
    start = ranked(linked, [], _ORDER, "_rank", buckets).withColumn("label", dealt(shares)).groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = cut(propagate(start, room, buckets, rounds).unionByName(parts.groupBy("g", "label").agg(F.sum("n").alias("n"))))
    placed = shared_out(joined.where("n > 1").drop("n"), parts, buckets)
    held = {r.label: r.n for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    # Unlinked documents fill up the quotas, in order of their rank.
    rest = ranked(joined.where("n IS NULL").drop("n"), [], _ORDER, "_rank", buckets)
    rest = rest.withColumn("label", dealt([q - held.get(j, 0) for j, q in enumerate(quotas)])).drop("_rank")
    every = cut(placed.unionByName(rest).withColumnRenamed("label", "shard"))
    release(spark, since, every)
    return ranked(every, ["shard"], _ORDER, "slot", buckets_for(n, shards)).drop("row")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
