"""MinHash near-deduplication (operator 3): sequential Bayesian verification of banded candidates.

1. Texts with the same set of shingles form a class; only classes are compared, so copies cost nothing. Classes
   have a signature of ``ROWS * BANDS`` minima, and classes that agree in a band share a bucket. A pair at similarity 0.75 shares
   none with a chance of (1 - 0.75^6)^50 = 6e-5.
2. A bucket proposes its most connected class (most companions over all its buckets) with every other: a star.
   Signatures of a pair are compared in batches of ``BATCH``; after each, the pair is dropped if the posterior chance
   (uniform prior) that its similarity reaches the threshold is below ``MISS``. Survivors are confirmed on their full sets.
3. Links join classes into components. A bucket whose other members lie in several components isn't done: it goes
   on with a new centre against members of other components, ``STARS`` times. What is left is joined on rare shingles, which is
   exact: in any fixed order of shingles (here rarest first) two sets at the threshold have their first common one early enough
   in both that what follows can still reach the needed overlap. The larger set looks among its first 25 %, the smaller is listed by its first 14 %
   only, under the sizes that a partner can have there: pages of one template whose own parts keep them below 0.75 are listed by these alone and
   meet nobody. So every pair that shares a bucket is compared, excluded by that
   bound or already connected, no pairs are made within a component, and neither large groups of near copies nor passages that
   many texts share make pairs of all their members.

Words are lower-cased (A-Z) runs of anything but ASCII white space; a shingle is five words, or all words of a shorter text.
Shingles count as equal if their 64-bit hashes are. Null texts and texts without words have empty sets and are linked with nothing.
Rows that share a doc_id are separate documents; those in one component share its component_id. An empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import WORD, cut, map_rows, mark, release, table
from metaloom.llm.graph import components
from metaloom.llm.words import hashed_words, mix

WIDTH, PERCENT, ROWS, BANDS, BATCH, MISS = 5, 75, 6, 50, 30, 1e-6
STARS = 2
_BLOCK = 1024
_INSIDE = ~np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
_seeded = np.random.Generator(np.random.PCG64(21))
_STEPS = _seeded.integers(1, 1 << 63, WIDTH, np.uint64) | np.uint64(1)
_XOR = _seeded.integers(0, 1 << 32, ROWS * BANDS, np.uint64).astype(np.uint32)
_ODD = _seeded.integers(0, 1 << 32, ROWS * BANDS, np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words, _ = hashed_words((text or "").encode().lower(), _INSIDE)
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    made = np.full(n, width, np.uint64)
    for k in range(width):
        made += words[k : k + n] * _STEPS[k]
    return np.unique(mix(made))


def signature(found: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minima of a set under all hash functions."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _BLOCK):
        np.minimum(low, ((x[i : i + _BLOCK, None] ^ _XOR) * _ODD).min(0), out=low)
    return (low >> np.uint32(3)).astype(np.uint16)


def class_of(found: np.ndarray) -> tuple[int, int]:
    """A set's name, and as much again of its digest, by which sets of one name are told apart."""
    made = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(made[:8], "little", signed=True), int.from_bytes(made[8:], "little", signed=True)


def least_matches() -> list[int]:
    """For each number of compared batches, the fewest matches at which a pair stays.

    With a uniform prior, m matches among n give a chance of P(Bin(n + 1, t) <= m) that the similarity is t or more.
    """
    t, out = PERCENT / 100, []
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        total = 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                out.append(m)
                break
    return out


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (rows) survive the sequential test."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


#: A row of documents: two rows that agree in these are equal in id and text.
_ROW = ["doc_id", "t1", "t2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds two independent 64-bit hashes of the text, which with doc_id say which row is meant."""
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])


def described(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, t1, t2, n_shingles, class, name and proof (null for an empty set) and, on one row of each class in a task, its signature.

    A class is a set; its number is the name, the first bits of the digest. Where sets of different proofs share a name (at 10^10
    sets some will) the numbers are made anew from both.
    """

    def make():
        seen: set[tuple[int, int]] = set()
        cutoff = (1 << bits - 1) - 1

        def run(keys, first, second, texts):
            sizes, names, proofs, signs = [], [], [], []
            for text in texts:
                found = shingles(text)
                c = class_of(found) if len(found) else None
                sizes.append(len(found))
                names.append(c and (c[0] if bits == 64 else c[0] & cutoff))
                proofs.append(c and c[1])
                signs.append(None if c is None or c in seen else signature(found).tobytes())
                if c and len(seen) < 1 << 18:
                    seen.add(c)
            return [keys, first, second, sizes, names, proofs, signs]

        return run

    rows = cut(map_rows(_keyed(docs.select("doc_id", "text")).select(*_ROW, "text"), make, "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, name bigint, proof bigint, signature binary"))
    clash = rows.where("name IS NOT NULL").groupBy("name").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").select("name")
    if clash.isEmpty():
        return rows.withColumn("class", F.col("name"))
    return cut(rows.join(clash.withColumn("_c", F.lit(True)), "name", "left").withColumn("class", F.when(F.col("_c"), F.xxhash64("name", "proof")).otherwise(F.col("name"))).drop("_c"))


def _verify(pairs: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the threshold."""
    joined = pairs.join(signs.select(F.col("class").alias("a"), F.col("signature").alias("sa")), "a").join(signs.select(F.col("class").alias("b"), F.col("signature").alias("sb")), "b")

    def test():
        def run(a, b, sa, sb):
            both = [np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (sa, sb)]
            keep = likely(*both).nonzero()[0]
            return [[a[i] for i in keep], [b[i] for i in keep]]

        return run

    kept = cut(map_rows(joined.select("a", "b", "sa", "sb"), test, "a bigint, b bigint"))
    joined = kept.join(sets.select(F.col("class").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("xb")), "b")

    def confirm():
        def run(a, b, xa, xb):
            keep = [i for i in range(len(a)) if similar(np.frombuffer(xa[i], np.uint64), np.frombuffer(xb[i], np.uint64))]
            return [[a[i] for i in keep], [b[i] for i in keep]]

        return run

    return cut(map_rows(joined.select("a", "b", "xa", "xb"), confirm, "a bigint, b bigint"))


def _sets(docs: DataFrame, signs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of wanted classes, made again from the text of the row that stands for each."""
    chosen = signs.join(wanted, "class").select("class", "proof", *_ROW)
    keyed = _keyed(docs.select("doc_id", "text"))
    texts = keyed.join(chosen, _same_row(keyed, chosen)).select("class", "proof", "text")

    def make():
        seen: set[int] = set()

        def run(classes, proofs, texts):
            out: tuple[list, list] = ([], [])
            for c, proof, text in zip(classes, proofs, texts, strict=True):
                if c not in seen:
                    found = shingles(text)
                    if len(found) and class_of(found)[1] == proof:  # else another text of the same hashes
                        seen.add(c)
                        out[0].append(c)
                        out[1].append(found.tobytes())
            return list(out)

        return run

    return cut(map_rows(texts, make, "class bigint, set binary").dropDuplicates(["class"]))


def _rare_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes (class, comp) of different components that can reach the threshold by where their first common shingle is."""

    def spread():
        def run(classes, comps, found):
            n = [len(x) // 8 for x in found]
            items = np.frombuffer(b"".join(found), np.int64).tolist()
            return [[c for c, k in zip(classes, n, strict=True) for _ in range(k)], [c for c, k in zip(comps, n, strict=True) for _ in range(k)], [k for k in n for _ in range(k)], items]

        return run

    items = map_rows(left.join(sets, "class").select("class", "comp", "set"), spread, "class bigint, comp bigint, n int, item bigint")
    df = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    ranked = items.join(df.hint("merge"), "item").groupBy("class", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item", "lo", "hi"))).alias("all"))
    # A pair at the threshold t has an overlap of t / (1 + t) of both sizes together. So its first common shingle is among the first
    # n - ceil(t n) + 1 of the larger set, and among the first n - ceil(2 t / (1 + t) n) + 1 of the smaller.
    near = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))
    rare = cut(ranked.select("class", "comp", "n", F.posexplode(near).alias("at", "x")).where("x.lo < x.hi").select("class", "comp", "n", "at", "x.item"))
    few = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)) + 1
    # What is left after a common shingle bounds both sizes together: the smaller set is found under the sizes that its partners can have.
    most = F.floor((100 + PERCENT) * (F.col("n") - F.col("at")) / PERCENT) - F.col("n")
    small = rare.where((F.col("at") < few) & (most >= F.col("n"))).select(F.col("class").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "item", F.explode(F.sequence(_step(F.col("n")), _step(most))).alias("step"))
    large = rare.withColumn("step", _step(F.col("n")))
    larger = F.struct("n", "class") > F.struct("n_b", "b")
    reach = (100 + PERCENT) * F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= PERCENT * (F.col("n") + F.col("n_b"))
    met = large.join(small.hint("merge"), ["item", "step"]).where(larger & (F.col("comp") != F.col("comp_b")) & reach)
    return met.select(F.col("class").alias("a"), "b").distinct()


def _step(n: Column) -> Column:
    """Sizes by steps of about a twentieth."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def links(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between classes that connect all that are similar, and (node, root) of the linked classes."""
    one = F.first(F.struct("signature", "proof", *_ROW)).alias("one")
    signs = cut(rows.where("signature IS NOT NULL").groupBy("class").agg(one).select("class", "one.*"))
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)])
    banded = signs.select("class", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(banded.join(shared.hint("merge"), "bucket"))
    known = members.groupBy("class").agg(F.sum("n").alias("company"))
    members = cut(members.join(known, "class").select("bucket", "class", "company"))
    heads = members.groupBy("bucket").agg(F.max(F.struct("company", "class")).alias("h")).select("bucket", F.col("h.class").alias("head"))
    members = cut(members.join(heads.hint("merge"), "bucket").where("class <> head"))  # a merge join, as large buckets can be split then
    pairs = _ordered(members.select(F.col("head").alias("a"), F.col("class").alias("b")))
    members = members.drop("head")
    sets = _sets(docs, signs, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    confirmed = _verify(pairs, signs, sets)
    found = components(confirmed)
    for turn in range(STARS):
        members = _open(members, found)
        if members.isEmpty():
            break
        if turn + 1 < STARS:
            members = members.where("class <> head")
            pairs = members.where("comp <> head_comp").select(F.col("head").alias("a"), F.col("class").alias("b"))
            members = members.select("bucket", "class", "company")
        else:
            pairs = _rare_pairs(members.select("class", "comp").distinct(), sets)
        confirmed = cut(confirmed.unionByName(_verify(_ordered(pairs), signs, sets)))
        found = components(confirmed)
    return confirmed, found


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with their components and a new centre."""
    placed = members.select("bucket", "class", "company").join(found.withColumnRenamed("node", "class"), "class", "left")
    placed = cut(placed.select("bucket", "class", "company", F.coalesce("root", "class").alias("comp")))
    state = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("company", "class", "comp")).alias("h")).where("lo <> hi")
    heads = state.select("bucket", F.col("h.class").alias("head"), F.col("h.comp").alias("head_comp"))
    return cut(placed.join(heads.hint("merge"), "bucket"))


def clustered(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text); written to the shared folder once. bits are those of a class's name."""
    since = mark()
    rows = described(docs, bits)
    _, found = links(docs, rows)
    placed = rows.select("doc_id", "n_shingles", "class").join(found.withColumnRenamed("node", "class"), "class", "left")
    placed = cut(placed.select("doc_id", "n_shingles", F.coalesce("root", "class").alias("comp")))
    least = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    component = F.coalesce("least", "doc_id")
    done = placed.join(least.hint("merge"), "comp", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    done = cut(done)
    release(docs.sparkSession, since, done)
    return done


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id (nulls last, then by hash of text).

    Rows with an empty set are linked with nothing and all stay; of rows equal in id and text one stays, whichever other columns it has.
    """
    since = mark()
    rows = described(docs)
    _, found = links(docs, rows)
    placed = rows.where("class IS NOT NULL").join(found.withColumnRenamed("node", "class"), "class", "left").select(*_ROW, F.coalesce("root", "class").alias("comp"))
    first = placed.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), *_ROW)).alias("m")).select("m.doc_id", "m.t1", "m.t2")
    stay = cut(first)
    many = rows.where("class IS NOT NULL").groupBy(*_ROW).count().where("count > 1")
    repeated = cut(many.join(stay, _same_row(many, stay), "left_semi").select(*_ROW))
    release(docs.sparkSession, since, stay, repeated)
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    keyed = docs.withColumn("_id", F.col("doc_id")).withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64(F.lit(1), "text")})
    same = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_t1") == other["t1"]) & (F.col("_t2") == other["t2"])
    kept = keyed.where(wordy).join(stay, same(stay), "left_semi")
    if not repeated.isEmpty():
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(kept.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_t1", "_t2"]))
    return kept.select(*docs.columns).unionByName(docs.where(~wordy))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents").select("doc_id", "text"))
