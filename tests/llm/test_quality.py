import numpy as np
from metaloom.llm import quality


def auc(scores, y):
    order = scores.argsort().argsort() + 1
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - ones * (ones + 1) / 2) / ones / zeros


def test_risk_is_learned_from_positives_and_unlabelled_only():
    r = np.random.default_rng(2)
    make = lambda n, shift: r.normal(shift, 1, (n, quality.GRAMS + quality.SHARES)).astype(np.float32) * (np.arange(quality.GRAMS + quality.SHARES) < 5)
    positive, unlabelled = make(1500, 0.7), np.concatenate([make(900, 0.7), make(600, -0.7)])
    model = quality.fit(positive, unlabelled, 0.6)
    x, y = np.concatenate([make(500, 0.7), make(500, -0.7)]), np.repeat([1, 0], 500)
    assert auc(model.raw(x), y) > 0.95


def test_features_of_odd_texts():
    assert not quality.features(None).any() and not quality.features("").any()
    for text in ("a", "é", "\n\n", "x" * 100_000, "😀 " * 1000):
        assert np.isfinite(quality.features(text)).all()


def test_query_held_out(spark):
    found = quality.op6_quality(spark, "/root/testdata/sf0.01")
    assert found.count() == 1000
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.95


def test_without_labels_and_without_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 0.0), (1, "a", 0.0), (None, "", 0.0)], "doc_id bigint, text string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, None)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [(x.score, x.predicted) for x in quality.op6_quality(spark, str(tmp_path)).collect()] == [(0.5, 0)] * 3
    assert quality.score(docs.limit(0), quality.constant(0.5)).count() == 0


def test_prior_is_estimated_without_negatives():
    r = np.random.default_rng(3)
    for share in (0.25, 0.5, 0.8):
        make = lambda n, shift: r.normal(shift, 1, (n, 40)).astype(np.float32)
        x = np.concatenate([make(2000, 0.6), make(int(3000 * share), 0.6), make(3000 - int(3000 * share), -0.6)])
        y, u = np.repeat([1, -1], [2000, 3000]), np.repeat([False, True], [2000, 3000])
        assert abs(quality.prior_of(x, u, y, r.random(5000) < 0.5, 0.99) - share) < 0.08
    assert quality.prior_of(x[:60], u[:60], y[:60], r.random(60) < 0.5, 0.4) == 0.4


def test_fit_reaches_the_risk_of_plain_descent():
    """Against gradient descent on the same risk with finite differences of few weights."""
    r = np.random.default_rng(5)
    p, u = r.normal(0.5, 1, (400, 3)), np.concatenate([r.normal(0.5, 1, (300, 3)), r.normal(-0.5, 1, (300, 3))])
    found = quality.fit(p.astype(np.float32), u.astype(np.float32), 0.5, steps=1500, decay=0.0)
    own = quality.risk(found.raw(p.astype(np.float32)), found.raw(u.astype(np.float32)), 0.5)

    def value(w):
        return quality.risk(p @ w[:3] + w[3], u @ w[:3] + w[3], 0.5)

    best, w, step = np.inf, np.zeros(4), 0.5
    for _ in range(3000):
        g = np.array([(value(w + d) - value(w - d)) / 2e-5 for d in np.eye(4) * 1e-5])
        w, step = w - step * g, step * 0.999
        best = min(best, value(w))
    assert own < best + 0.01


def test_samples_are_bounded_for_each_label(spark):
    """One label in a thousand is positive, and one row is there many times."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(20_000).selectExpr("0L AS doc_id", "'again' AS text"))
    known = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 1000 = 0 AS int) AS y")
    rates = {1: min(1.0, 300 / 60), 0: 300 / 59_940}
    rows = quality.sampled(docs, known, rates, 300 / 80_000).collect()
    ones, zeros, others = sum(r.y == 1 for r in rows), sum(r.y == 0 for r in rows), sum(r.in_u for r in rows)
    assert ones == 60 and 200 < zeros < 400 and 100 < others < 400 and len({r.doc_id for r in rows}) == len(rows)
    assert [r.y for r in rows if r.doc_id == 0] == [1]
