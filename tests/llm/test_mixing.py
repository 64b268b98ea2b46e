import random
import re

from metaloom.llm import common, mixing
from pyspark.sql import functions as F


def expected(rows):
    """Sizes, and each source's size and target, by reshaping until nothing changes."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    capped, total = set(), 1.5 * sum(words.values())
    while True:
        free = [s for s in sources if s not in capped]
        rest = total - sum(2 * words[s] for s in capped)
        target = {s: 2.0 * words[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in sources}
        over = {s for s in free if target[s] > 2 * words[s]}
        if not over:
            return size, words, target
        capped |= over


def test_targets_and_taken_words(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for s, n in ((None, 30), ("", 5), ("a", 200), ("B", 40), ("é", 60), ("z", 1)):
        rows += [(len(rows) + i, s, r.choice([None, "", " "]) if r.random() < 0.1 else "w\t" * r.randrange(1, 80)) for i in range(n)]
    rows += rows[50:60] * 3
    size, words, target = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    first = mixing.mix(docs)
    found = first.collect()
    assert len(found) == len(rows)
    assert sorted((x.doc_id, x["size"]) for x in found) == sorted((i, size(t)) for i, _, t in rows)
    for s in words:
        own = [x for x in found if x.source == s]
        assert all(x.source_size == words[s] and abs(x.target - target[s]) < 1e-6 * max(1, target[s]) for x in own)
        assert all(x.taken in (0, x["size"], 2 * x["size"]) for x in own)
        if len(own) > 1:
            assert abs(sum(x.taken for x in own) - target[s]) <= max(x["size"] for x in own)
    key = lambda x: (x.doc_id, x["size"], x.taken)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix(docs).collect()))


def test_mixed_rows_and_extra_columns(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "word " * (1 + i % 7), i, "t") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size bigint, target string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    taken = {}
    for x in mixing.op8_mix(spark, str(tmp_path)).collect():
        taken[x.doc_id] = x.taken
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    counts = {x.doc_id: x["count"] for x in rows.groupBy("doc_id").count().collect()}
    assert {i: taken[i] // (1 + i % 7) for i in taken if taken[i]} == counts


def test_long_documents_do_not_break_the_sum(spark):
    rows = [(i, "s", "w " * 10) for i in range(100)] + [(1000, "s", "w " * 5000), (2000, "t", "w " * 4000), (2001, "t", "w")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    assert sum(x.taken for x in found if x.source == "s") > 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.mix(docs).count() == 0
    assert [x.taken for x in mixing.mix(spark.createDataFrame([(1, None, None)], docs.schema)).collect()] == [0]


def sampled(rows, p, wanted, rounds):
    """The brute-force sample of one source: rows are (u, r, size, key), p is each key's chance; copies of each key."""
    order = sorted((((o := u / (1 - u) * (1 - p[key]) / p[key]) / (1 + o), r, size), key) for u, r, size, key in rows if size and p[key] < 1)
    taken, left, at = {}, wanted, None
    for _ in range(rounds):
        limit, passed = left, False
        for place, key in order:
            if place[2] <= limit and (at is None or place > at):
                if place[2] > left:
                    at, passed = place, True
                    break
                taken[key] = 1
                left -= place[2]
        if not passed:
            break
    return taken


def test_sample_equals_brute_force_and_keeps_to_its_probabilities(spark, monkeypatch):
    monkeypatch.setattr(common, "BUCKET_ROWS", 100)
    r = random.Random(4)
    rows = [(i, "abc"[i % 7 % 3], "w " * r.choice((1, 3, 10, 30, 90)) + ("x " * 20_000 if i == 700 else "")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = {x.doc_id: x for x in mixing.mix(docs).collect()}
    hashes = {x.doc_id: x.r for x in docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)).alias("r")).collect()}
    size, words, target = expected(rows)
    for s in words:
        whole = int(target[s] // words[s])
        rest = target[s] - whole * words[s]
        own = [(i, size(t)) for i, x, t in rows if x == s]
        if rest:
            p = chances(own, rest)
            assert all(abs(found[i].chance - p[i]) < 1e-9 for i, _ in own) and abs(sum(p[i] * n for i, n in own) - rest) < 1e-6 * rest
            sure = {i for i, _ in own if p[i] >= 1}
            left = rest - sum(n for i, n in own if i in sure)
            wanted = sampled([((hashes[i] % (1 << 52) + 0.5) / (1 << 52), hashes[i], n, i) for i, n in own], p, left, 1 + mixing.ROUNDS)
            assert {i for i, _ in own if found[i].copies > whole} == set(wanted) | sure


def chances(own, rest):
    """min(1, a * size^POWER) of each key of one source, by halving the range of a."""
    low, high = 0.0, 1e9
    for _ in range(300):
        a = (low + high) / 2
        low, high = (low, a) if sum(min(1.0, a * n**mixing.POWER) * n for _, n in own) > rest else (a, high)
    return {i: min(1.0, low * n**mixing.POWER) for i, n in own}


def test_rates_over_seeds_are_the_documents_own_chances(spark):
    r = random.Random(6)
    rows = [(i, "ab"[i % 4 == 0], "w " * r.choice((1, 4, 16, 64))) for i in range(3200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    seeds, hits, chance, whole = 4, {}, {}, {}
    for seed in range(seeds):
        for x in mixing.mix(docs, seed=seed).collect():
            chance[x.doc_id, x.source, x["size"]] = x.chance
            whole[x.source] = int(x.target // x.source_size)
            hits[x.source, x["size"]] = hits.get((x.source, x["size"]), 0) + x.copies - whole[x.source]
    tried = 0
    for (source, n), got in hits.items():
        own = [p for (_, s, k), p in chance.items() if s == source and k == n]
        p, m = own[0], len(own) * seeds
        assert max(own) - min(own) < 1e-12
        if 0 < p < 1:
            tried += 1
            assert abs(got / m - p) < 4.5 * (p * (1 - p) / m) ** 0.5 + 0.01, (source, n, got / m, p)
    assert tried >= 4 and len({round(p, 6) for p in chance.values()}) >= 5


def test_columns_of_any_names(spark):
    names = ["p", "_key", "_rank", "_place", "_more", "_h1", "_copies", "_k", "_n", "Size", "_doc", "_t", "_whole"]
    docs = spark.createDataFrame([(i, "s", "a b c", *[f"{n}{i}" for n in names]) for i in range(20)], "doc_id bigint, source string, text string, " + ", ".join(f"{n} string" for n in names))
    found = mixing.mix(docs).collect()
    assert all(x._key == f"_key{x.doc_id}" and x.p == f"p{x.doc_id}" for x in found) and len(found) == 20
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and all(x["_copies"] == f"_copies{x.doc_id}" for x in mixed.collect())


def test_one_row_many_times(spark):
    rows = [(1, "s", "a b c")] * 500 + [(2, "t", "x")] * 400
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    for s in "st":
        own = [x for x in found if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= own[0]["size"]
