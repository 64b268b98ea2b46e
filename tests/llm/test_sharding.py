import random
import zlib
from collections import Counter, defaultdict

from metaloom.llm import sharding


def check(found, rows, shards=8):
    assert sorted((x.doc_id or 0, x["size"], x.text_crc32) for x in found) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(x.shard for x in found)
    sizes = [counts[j] for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for j in range(shards):
        assert sorted(x.slot for x in found if x.shard == j) == list(range(counts[j]))


def test_small_groups_stay_together(spark):
    r = random.Random(3)
    rows = [(i, f"text {i}") for i in range(300)]
    for k in range(60):
        rows += [(1000 + 20 * k + i, f"group {k}") for i in range(r.randrange(2, 6))]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(found, rows)
    places = defaultdict(set)
    for x in found:
        places[x.g].add(x.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 2


def test_everything_linked_and_a_hot_group(spark):
    for rows in ([(i, f"g{i // 3}") for i in range(600)], [(i, "hot" if i % 3 == 0 else f"g{i // 2}") for i in range(600)], [(i, "same") for i in range(101)]):
        found = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        check(found, rows)
    found = sharding.sharded(spark.createDataFrame([(i, f"g{i // 3}") for i in range(600)], "doc_id bigint, text string")).collect()
    places = defaultdict(set)
    for x in found:
        places[x.g].add(x.shard)
    assert sum(len(p) - 1 for p in places.values()) < 120  # spread evenly at first, nearly all of 200 groups are cut twice


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, "é"), (None, None), (3, "x" * 100_000)]
    spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id bigint, text string, shard int, g string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sharding.op10_shard(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(found.collect(), rows)
    assert sharding.sharded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_large_groups_are_cut_only_where_quotas_demand_it(spark):
    sizes = {"hot": 1334, **{f"a{k}": 200 for k in range(4)}, **{f"b{k}": 100 for k in range(4)}}  # n/3, n/20 and n/40 of 4000
    texts = [g for g, n in sizes.items() for _ in range(n)] + [f"pair {k // 2}" for k in range(200)]
    rows = list(enumerate(texts + [f"alone {k}" for k in range(4000 - len(texts))]))
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(found, rows)
    places = defaultdict(Counter)
    for x in found:
        places[rows[x.doc_id][1]][x.shard] += 1
    assert {g: len(places[g]) for g in sizes} == {g: 3 if g == "hot" else 1 for g in sizes}
    assert sorted(places["hot"].values()) == [334, 500, 500]
    assert sum(len(places[f"pair {k}"]) > 1 for k in range(100)) <= 5


def test_plan_of_large_groups():
    room = [500] * 8
    parts = sharding.planned([(f"g{k}", 400) for k in range(10)], room)
    assert room == [0] * 8 and sum(b - a for _, a, b, _ in parts) == 4000
    assert sorted(Counter(g for g, *_ in parts).values()) == [1] * 8 + [4, 4]
    assert sharding.planned([], [1, 2]) == []


def test_a_group_in_every_bucket_is_shared_out_exactly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL", 1)
    monkeypatch.setattr(sharding, "HOT", 4)
    sizes = {f"g{k}": 3 + 7 * k for k in range(20)}
    rows = list(enumerate([g for g, n in sizes.items() for _ in range(n)] + [None] * 50))
    check(sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)
