import numpy as np
from metaloom.llm import ann


def brute(rows, k=10):
    """Exact answers over the rows that take part."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q)[:k]
    return out


def recall(found, wanted):
    hit = total = 0
    for q, near in wanted.items():
        got = {r.vec_id for r in found if r.query_id == q}
        hit += len(got & {i for _, i in near})
        total += len(near)
    return hit / total


def table(spark, rows, path):
    spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double").write.parquet(f"{path}/embeddings.parquet")


def test_recall_copies_and_bad_vectors(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] * 8), (3300, [None] * 8), (3400, [1.0] * 7), (3500, [float("inf")] * 8)]
    table(spark, rows, tmp_path)
    monkeypatch.setattr(ann, "BLOCK", 8)
    wanted = brute(rows)
    for size in (5000, 400):
        found = ann.nearest(*(lambda v: (v, v.where("vec_id % 100 = 0")))(ann.clean(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))), shard_rows=size).collect()
        assert {x.query_id for x in found} == set(wanted) and recall(found, wanted) > 0.97
        exact = {i: np.array(v, float) for i, v in rows if i < 3000}
        assert all(x.score == float(np.sqrt(((exact[x.vec_id] - exact[x.query_id]) ** 2).sum())) for x in found)
        for q in wanted:
            own = sorted((x for x in found if x.query_id == q), key=lambda x: x["rank"])
            assert [x["rank"] for x in own] == list(range(1, 11))
            assert [(x.score, x.vec_id) for x in own] == sorted((x.score, x.vec_id) for x in own)
        assert [x.vec_id for x in sorted((x for x in found if x.query_id == 0), key=lambda x: x["rank"])] == [2000 + i for i in range(10)]


def test_few_rows(spark, tmp_path):
    table(spark, [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [3.0, 4.0])], tmp_path)
    found = sorted((x.query_id, x["rank"], x.vec_id) for x in ann.op5_nearest(spark, str(tmp_path)).collect())
    assert found == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    table(spark, [], f"{tmp_path}/none")
    assert ann.op5_nearest(spark, f"{tmp_path}/none").count() == 0


def test_recall_on_the_given_table(spark):
    found = ann.op5_nearest(spark, "/root/testdata/sf0.1").collect()
    rows = [(x.vec_id, np.array(x.embedding, float)) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    every, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    wanted = {}
    for i, v in rows:
        if i % 100 == 0:
            far = np.sqrt(((every - v) ** 2).sum(1))
            wanted[i] = sorted((f, j) for f, j in zip(far.tolist(), ids.tolist(), strict=True) if j != i)[:10]
    assert recall(found, wanted) > 0.95
    exact = dict(rows)
    assert all(abs(x.score - float(np.sqrt(((exact[x.vec_id] - exact[x.query_id]) ** 2).sum()))) < 1e-12 for x in found)


def test_shards_follow_the_number_of_vectors():
    assert [ann.shards_of(n) for n in (0, 1, 4000, 4001, 256_000, 10_000_000, 10**9)] == [1, 1, 1, 2, 64, 500, 50_000]
    assert ann.beam_of(100) == ann.beam_of(4000) == 48 and ann.beam_of(20_000) == 188
