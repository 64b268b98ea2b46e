import random
import re

import numpy as np
from metaloom.llm import neardup
from metaloom.llm.graph import components
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """By comparing every pair."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed=1, groups=25):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ñ", "The"]
    shared = [r.choice(vocab) for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randrange(20, 200))] + (shared if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 15)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w) if r.random() < 0.5 else "\n\t".join(w).upper())
    out += [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f", "x y " * 50, "x y " * 60]
    out += out[:5]
    keys = r.sample(range(10_000), len(out))
    return list(zip(keys, out, strict=True))


def test_sets_and_test_of_similarity():
    for _, text in corpus(3, 8):
        assert len(neardup.shingles(text)) == len(shingle_set(text))
    a, b = neardup.shingles("A b\x0bc d e"), neardup.shingles("a  b\tc d e\r")
    assert (a == b).all() and len(a) == 1
    assert neardup.similar(np.arange(7, dtype=np.uint64), np.arange(1, 7, dtype=np.uint64)) and not neardup.similar(np.arange(4, dtype=np.uint64), np.arange(1, 5, dtype=np.uint64))


def test_signatures_estimate_similarity_and_bounds_keep_true_pairs():
    r = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.95):
        a, b = [], []
        for _ in range(200):
            x = r.integers(0, 1 << 63, 800, np.uint64)
            common = int(800 * 2 * share / (1 + share))
            y = np.concatenate((x[:common], r.integers(0, 1 << 63, 800 - common, np.uint64)))
            a.append(neardup.signature(x))
            b.append(neardup.signature(y))
        a, b = np.array(a), np.array(b)
        assert abs((a == b).mean() - share) < 0.02
        assert neardup.likely(a, b).mean() == (0.0 if share < 0.5 else 1.0)


def test_components_equal_brute_force(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(400, 450)]
    roots = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    groups = {n: {n} for p in pairs for n in p}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for n in groups[b]:
                groups[n] = groups[a]
    for n, g in groups.items():
        if len(g) > 1:
            assert {roots[x] for x in g} == {roots[n]} and roots[n] in g
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_clusters_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, neardup.clustered(docs).collect())) == brute(rows)
    monkeypatch.setattr(neardup, "STARS", 1)
    assert sorted(map(tuple, neardup.clustered(docs).collect())) == brute(rows)


def test_odd_rows(spark, tmp_path):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (None, text), (3, None), (4, ""), (9, "other words in this one here")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(str, neardup.op3_near_duplicates(spark, str(tmp_path)).collect()))
    assert len(found) == 6 and sum("component_id=5" in x for x in found) == 3
    assert neardup.clustered(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sets_that_share_a_name_stay_apart(spark):
    rows = corpus(7, 8)
    assert sorted(map(tuple, neardup.clustered(spark.createDataFrame(rows, "doc_id bigint, text string"), bits=4).collect())) == brute(rows)


def test_null_ids_cost_no_more_than_others(spark):
    texts = [f"a{i} b{i % 7} c d e f g{i // 2}" for i in range(400)]
    with_ids = neardup.clustered(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    without = neardup.clustered(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string"))
    assert with_ids.agg(F.sum("n_shingles")).first() == without.agg(F.sum("n_shingles")).first()
    sets = neardup._sets(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string"), *signed(spark, texts))
    assert sets.count() == len({neardup.class_of(neardup.shingles(t)) for t in texts})


def signed(spark, texts):
    rows = neardup.described(spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")).where("signature IS NOT NULL").dropDuplicates(["class"])
    return rows, rows.select("class")


def test_intermediate_tables_are_deleted(spark):
    from metaloom.llm import common

    common.drop_tables(spark)
    found = neardup.clustered(spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e")], "doc_id bigint, text string"))
    assert len(common._written.tables) == 1 and found.where("kept").count() == 1


def test_pages_of_one_template(spark):
    r = random.Random(5)
    frame = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(frame + [f"o{i}_{j}" for j in range(20 if i % 2 else r.randrange(3, 60))])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, neardup.clustered(docs).collect())) == brute(rows)
    sets = [(i, i, neardup.shingles(t).tobytes()) for i, t in rows]
    left = spark.createDataFrame([(i, c) for i, c, _ in sets], "class bigint, comp bigint")
    pairs = {(x.a, x.b) for x in neardup._rare_pairs(left, spark.createDataFrame([(i, s) for i, _, s in sets], "class bigint, set binary")).collect()}
    found = {i: np.frombuffer(s, np.uint64) for i, _, s in sets}
    near = {(a, b) for a in found for b in found if (len(found[a]), a) > (len(found[b]), b) and neardup.similar(found[a], found[b])}
    assert near and pairs == near  # nothing else is proposed
