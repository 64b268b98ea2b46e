"""Quality classifier (operator 6): positive-unlabelled learning with the non-negative unbiased risk.

Features of a whole text: frequencies of hashed byte trigrams, and shares that tell prose from junk
(upper case, digits, marks, repeated words, repeated lines, lengths). A linear model minimises
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` over trusted positives (label 1) and unlabelled
documents. The class prior is estimated from positives and unlabelled documents alone (best-bin estimate): a first model,
trained on one half of both, scores the other half, and the prior is the least ratio of the unlabelled share above a threshold to the
positive share above it, where both shares are known well enough. Label 0 has no part in risk or prior. As the risk orders texts but
doesn't fix the scale, the score is calibrated by a one-variable logistic fit on labelled rows of the training folds, and this is the
only place where label 0 is used.

Training takes a bounded sample by hash of doc_id: about ``POSITIVES`` ids with label 1, ``NEGATIVES`` with label 0 and ``UNLABELLED`` others
(``train``'s parameters), each with a rate of its own, whatever the labels' shares are, and one row for each id (the smallest hash of its text);
calibration weighs labels by their rates. Everything else reads all rows. Null and empty texts have all features 0 and get the
score of that vector; repeated rows score alike. Without labels of both classes, all scores are the share of label 1, or 0.5
without any label. An empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import fold, map_rows, table

GRAMS, SHARES = 1024, 16
#: Bytes of a text whose trigram frequencies count half.
SHORT = 200
POSITIVES, NEGATIVES, UNLABELLED, STEPS = 6000, 6000, 6000, 250
THRESHOLD = 0.7
#: Rows that each half needs for an estimate of the prior.
LEAST = 50
_CELLS = 1_000_000


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text."""
    x = np.zeros(GRAMS + SHARES, np.float32)
    if not text:
        return x
    b = np.frombuffer(text.encode(), np.uint8)
    n = len(b)
    for start in range(0, max(1, n - 2), 1 << 22):
        c = b[start : start + (1 << 22) + 2].astype(np.uint32)
        h = (c[:-2] * 0x9E3779B1 + c[1:-1] * 0x85EBCA77 + c[2:] * 0xC2B2AE3D).astype(np.uint32) >> np.uint32(22)
        x[:GRAMS] += np.bincount(h.astype(np.int64), minlength=GRAMS)
    trust = n / (n + SHORT)
    x[:GRAMS] = trust * np.sqrt(x[:GRAMS] / max(1, n - 2))
    kinds = _KINDS[np.bincount(b, minlength=256).nonzero()[0]], np.bincount(b, minlength=256)
    by = np.bincount(kinds[0], weights=kinds[1][kinds[1] > 0], minlength=6) / n
    words, lines = text.split(), [s for s in text.split("\n") if s]
    w = max(1, len(words))
    upper, lower = by[1], by[2]
    again = sum(map(eq, words, words[1:])) / w
    fresh = len(set(words)) / w
    shares = [upper, lower, by[3], by[4], by[0], by[5], upper / (upper + lower + 0.01), again, fresh, len(set(lines)) / max(1, len(lines)), min(1, n / w / 20), min(1, np.log1p(n) / 12), np.sqrt(again), np.sqrt(by[4]), np.sqrt(upper), trust]
    x[GRAMS:] = shares
    return x


#: Of each byte: white space, upper case, lower case, digit, other ASCII, beyond ASCII.
_KINDS = np.array([0 if chr(i).isspace() and i < 128 else 1 if 65 <= i <= 90 else 2 if 97 <= i <= 122 else 3 if 48 <= i <= 57 else 4 if i < 128 else 5 for i in range(256)])


class Model:
    """Weights of standardised features, and the calibration of the raw score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights = (weights / scale).astype(np.float32)
        self.bias = float(bias - (mean / scale) @ weights)
        self.slope, self.shift = slope, shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def constant(score: float) -> Model:
    zero = np.zeros(GRAMS + SHARES)
    return Model(zero, zero + 1, zero, 0.0, 1.0, float(np.log(score / (1 - score))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = 1e-2) -> Model:
    """Minimises the non-negative risk with the logistic loss; where the negative part falls below 0, a step raises it."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, bias = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        fp, fu = p @ w + bias, u @ w + bias
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = -prior * (1 - sp) / len(p), np.zeros_like(su)
        gp, gu = -prior * sp / len(p), su / len(u)
        if negative >= 0:
            gp, gu = gp + up, gu + uu
        else:
            gp, gu = -gp, -gu
        g = np.append(gp @ p + gu @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = (w - move[:-1]).astype(np.float32), bias - float(move[-1])
    return Model(mean, scale, w, bias)


def risk(model_scores_p: np.ndarray, model_scores_u: np.ndarray, prior: float) -> float:
    """The non-negative risk of raw scores of positives and unlabelled rows."""
    negative = np.logaddexp(0, model_scores_u).mean() - prior * np.logaddexp(0, model_scores_p).mean()
    return float(prior * np.logaddexp(0, -model_scores_p).mean() + max(0.0, negative))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of rows that the scoring model hasn't seen.

    Above any threshold lie at most prior times the positives' share of positives; the threshold is chosen at which this ratio plus its
    margin of error (Dvoretzky, Kiefer and Wolfowitz at 90 %) is least.
    """
    at = np.sort(positive)
    above_p = 1 - np.arange(len(at)) / len(at)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    error = np.sqrt(np.log(40) / 2 / len(unlabelled)) + np.sqrt(np.log(40) / 2 / len(positive))
    best = int(((above_u + 1.01 * error) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """A weighted logistic fit of the label on the raw score, by Newton's method with a little shrinkage."""
    raw = model.raw(x)
    center, spread = raw.mean(), raw.std() + 1e-6
    z, (a, b) = (raw - center) / spread, (1.0, 0.0)
    for _ in range(30):
        q = _sigmoid(a * z + b)
        s = weight * q * (1 - q)
        grad = np.array([(weight * (q - y) * z).sum() + 0.1 * a, (weight * (q - y)).sum() + 0.01 * b])
        hess = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    model.slope, model.shift = float(max(a, 1e-6) / spread), float(b - a * center / spread)
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _share(salt: int, rate) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(salt)), F.lit(_CELLS)) < F.floor(rate * _CELLS)


def sampled(docs: DataFrame, known: DataFrame, rates: dict[int, float], of_docs: float) -> DataFrame:
    """doc_id, text, in_u, y and half of the rows to learn from: of known (doc_id, y) at the rate of each label, of docs at of_docs."""
    rate = F.when(F.col("y") == 1, rates[1]).otherwise(rates[0])
    chosen = known.where(_share(1, rate))
    either = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (_share(1, F.lit(max(rates.values()))) | _share(2, F.lit(of_docs)))).withColumn("in_u", _share(2, F.lit(of_docs)))
    rows = either.join(chosen, "doc_id", "left").where("in_u OR y IS NOT NULL")
    order = F.struct(F.xxhash64("text"), F.isnull("text"))
    return rows.groupBy("doc_id", "in_u", "y").agg(F.min_by("text", order).alias("text")).withColumn("half", _share(4, F.lit(0.5)))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, negatives: int = NEGATIVES) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, quality in 0 or 1). Ids whose labels disagree or are null don't count."""
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y AND y IN (0, 1)").select("doc_id", "y")
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not 0 < ones < n:
        return constant(min(max(ones / n, 0.01), 0.99) if n else 0.5)
    rates = {1: min(1.0, positives / ones), 0: min(1.0, negatives / (n - ones))}
    sample = sampled(docs, known, rates, min(1.0, unlabelled / max(1, docs.count())))

    def make():
        return lambda u, y, half, texts: [u, y, half, [features(t).astype(np.float16).tobytes() for t in texts]]

    rows = map_rows(sample.select("in_u", "y", "half", "text"), make, "in_u boolean, y int, half boolean, x binary").collect()
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, GRAMS + SHARES), np.float32)
    u, y = np.array([r.in_u for r in rows], bool), np.array([-1 if r.y is None else r.y for r in rows])
    if not (u.any() and (y == 1).any() and (y == 0).any()):
        return constant(ones / n)
    half = np.array([r.half for r in rows], bool)
    weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])[y >= 0]
    return calibrate(fit(x[y == 1], x[u], prior_of(x, u, y, half, ones / n)), x[y >= 0], y[y >= 0], weight / weight.mean())


def prior_of(x: np.ndarray, u: np.ndarray, y: np.ndarray, half: np.ndarray, otherwise: float) -> float:
    """The estimated class prior; too few rows in a half give the share of label 1 instead."""
    parts = [(y == 1) & half, u & half, (y == 1) & ~half, u & ~half]
    if min(part.sum() for part in parts) < LEAST:
        return otherwise
    first = fit(x[parts[0]], x[parts[1]], 0.5, STEPS // 2)
    return estimate_prior(first.raw(x[parts[2]]), first.raw(x[parts[3]]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda keys, texts: [keys, [float(s) for s in m.score(np.stack([features(t) for t in texts]))]]

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def make():
        m = shared.value

        def run(*columns):
            keep = (m.score(np.stack([features(t) for t in columns[at]])) >= threshold).tolist()
            return [[x for x, k in zip(c, keep, strict=True) if k] for c in columns]

        return run

    return map_rows(docs, make, ", ".join(f"{c} {kind}" for c, kind in docs.dtypes))


def training_rows(docs: DataFrame, labels: DataFrame) -> Model:
    """The contract's folds: rows whose crc32 of doc_id, modulo 4, is 2 are held out."""
    return train(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = training_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
