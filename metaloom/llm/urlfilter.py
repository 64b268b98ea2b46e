"""URL filters (operator 2): rules first, then gradient-boosted trees on lexical features.

A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's; the longest that fits
wins. URLs that a rule labels train the trees; the trees judge the others. Features: lengths of URL, host,
path and query, path depth, number of host labels, shares of digits, letters and marks, character entropy, numbers of
parameters and of hyphens, a fragment, and statistics of the host's suffix (the host without its first label, if it has three or more): how
many URLs there are under it, their mean depth and their mean share of digits. All of it runs as DataFrame expressions and JVM trees.

No feature holds a label or names what a rule tests: a rule's labels follow from host and path prefix alone, so shares of labels
by suffix or segment would only spell the rules out again, and trees on them would judge all other URLs of a suffix by a rule that
doesn't fit them. What the trees know is how URLs that were blocked or allowed are written.

Training takes about ``LABELLED`` labelled URLs by hash (a parameter); suffix statistics use all URLs. Null
URLs and URLs without `://` have an empty host and path. Without labels of both classes the one class that occurs is the
verdict of all, and without any, allow. Repeated rows are judged alike; other columns of pages don't count.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.llm.common import cut, table

#: The rules of the query, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LABELLED, TREES, DEPTH, LEAF = 20_000, 20, 4, 20
#: Suffixes up to which their table is sent to all executors; beyond, only those with more than 1/FEW of all URLs are.
FEW = 10_000
_CELLS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host", "f_path", "f_query", "f_depth", "f_labels", "f_digits", "f_letters", "f_marks", "f_entropy", "f_params", "f_hyphens", "f_fragment", "f_suffix_urls", "f_suffix_depth", "f_suffix_digits")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule as text, and its verdict; both null where none fits. Of two rules of one length the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that depend on the URL alone; urls has url, host and path."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    kept = lambda unwanted: F.length(F.regexp_replace(u, unwanted, "")) / n
    signs = F.array_distinct(F.split(u, ""))
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9))))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return urls.select(
        "*",
        F.regexp_replace("host", r"^[^.]*\.([^.]*\..*)$", "$1").alias("_suffix"),
        F.length(u).cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host"),
        F.length("path").cast("double").alias("f_path"),
        F.length(query).cast("double").alias("f_query"),
        F.size(segments).cast("double").alias("f_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_labels"),
        kept("[^0-9]").alias("f_digits"),
        kept("[^A-Za-z]").alias("f_letters"),
        kept("[A-Za-z0-9]").alias("f_marks"),
        entropy.alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("f_params"),
        (F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit("")))).cast("double").alias("f_hyphens"),
        F.contains(u, F.lit("#")).cast("double").alias("f_fragment"),
    )


def with_suffixes(urls: DataFrame) -> DataFrame:
    """lexical() urls with the statistics of their hosts' suffixes and the vector of all features.

    A suffix may hold most URLs, so none is joined by shuffling it: the table of suffixes is sent out whole, or, where it is long, in
    its part of at most FEW large suffixes, and the others are shuffled.
    """
    stats = cut(urls.groupBy("_suffix").agg(F.count(F.lit(1)).alias("_n"), F.avg("f_depth").alias("f_suffix_depth"), F.avg("f_digits").alias("f_suffix_digits")))
    suffixes, n = stats.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if suffixes <= FEW:
        joined = urls.join(F.broadcast(stats), "_suffix")
    else:
        large = stats.where(F.col("_n") > n // FEW)
        told = urls.join(F.broadcast(large), "_suffix", "left")
        added = [c for c in stats.columns if c != "_suffix"]
        joined = told.where("_n IS NOT NULL").unionByName(told.where("_n IS NULL").drop(*added).join(stats, "_suffix"))
    joined = joined.withColumn("f_suffix_urls", F.log1p(F.col("_n") / F.lit(max(1, n)) * 1e6)).drop("_n")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(joined)


class Filter:
    """Trained trees, or the one verdict there is."""

    def __init__(self, trees: GBTClassificationModel | None, only: str = "allow"):
        self.trees, self.only = trees, only

    def judge(self, urls: DataFrame) -> DataFrame:
        """Adds judged (allow or block) and p_block to urls with features."""
        if self.trees is None:
            return urls.withColumn("judged", F.lit(self.only)).withColumn("p_block", F.lit(float(self.only == "block")))
        from pyspark.ml.functions import vector_to_array

        scored = self.trees.transform(urls)
        return scored.withColumn("judged", F.when(F.col("prediction") == 1, "block").otherwise("allow")).withColumn("p_block", F.element_at(vector_to_array("probability"), 2))

    def importances(self) -> dict[str, float]:
        return dict(zip(FEATURES, self.trees.featureImportances.toArray().tolist(), strict=True)) if self.trees else {}


def train(urls: DataFrame, bound: int = LABELLED) -> Filter:
    """urls: url, features and verdict (allow, block or null)."""
    rows = urls.where("verdict IS NOT NULL").withColumn("label", (F.col("verdict") == "block").cast("double"))
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not 0 < blocked < n:
        return Filter(None, "block" if n and blocked else "allow")
    sample = rows.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(_CELLS)) < int(_CELLS * min(1.0, bound / n)))
    weighted = sample.withColumn("_weight", F.when(F.col("label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
    trainer = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=LEAF)
    return Filter(trainer.fit(weighted.select("_features", "label", "_weight")))


def featured(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict (null without a rule) and features of every row of pages (page_id, url)."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    return with_suffixes(lexical(urls.withColumns({"rule": rule, "verdict": verdict})))


def filtered(pages: DataFrame, rules=RULES, bound: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url), and the trees' probability of block."""
    urls = featured(pages, rules)
    return train(urls, bound).judge(urls).select("page_id", "host", "path", "rule", F.coalesce("verdict", "judged").alias("verdict"), "p_block")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url"))
