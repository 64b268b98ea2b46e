import random
import re

from metaloom.llm import urlfilter
from pyspark.sql import functions as F

URLS = [None, "", "no scheme", "://", "x://H.NET", "http://NET/", "http://a.net/x?y#z", "https://www.example.net/en/1", "http://example.net/EN/1", "http://notexample.net/en/", "ftp://example.com/de/?q", "http://m.example.com/de/é", "http://a.org/fr/", "http://org/fr/x", "http://b.org/frx", "http://ÄA.net/", "http://a?b://c/d", "http://a.net?x=/en/", "http://a\n.net/q\nr?x"]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES.get(rule)


def test_rules_equal_brute_force(spark, tmp_path):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    spark.createDataFrame(rows, "page_id bigint, url string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in urlfilter.op2_url_filter(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), u
        assert found[i].verdict == verdict if rule else found[i].verdict in ("allow", "block")


def test_trees_learn_lexical_signs_and_hold_on_other_hosts(spark, monkeypatch):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("aeiouthns") for _ in range(n))
    hosts = [f"{word(4)}.{word(5)}.com" for _ in range(40)]

    def url(kind):
        """Blocked ones are deep, or full of digits, or have many parameters; all are of about one length, and allowed ones have digits and hyphens too."""
        long = lambda: r.randrange(16, 30)
        tail = {0: word(long()), 1: "/".join(word(r.randrange(2, 5)) for _ in range(6)), 2: "".join(r.choice("0123456789") for _ in range(long())), 3: f"{word(long() - 12)}?a=1&b=2&c=3", 4: "-".join(word(r.randrange(2, 5)) for _ in range(6)), 5: word(long() - 10) + "".join(r.choice("0123456789") for _ in range(10))}[kind]
        return f"http://{r.choice(hosts)}/{tail}"

    rows = [(i, url(k), "allow" if k in (0, 4, 5) else "block") for i, k in enumerate([0, 1, 5, 2, 4, 3] * 250)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label string")
    for few in (10_000, 20):
        monkeypatch.setattr(urlfilter, "FEW", few)
        urls = urlfilter.featured(pages, ()).drop("verdict").join(pages.select("page_id", F.col("label").alias("verdict")), "page_id")
        train, test = urls.where("pmod(hash(host), 4) > 0"), urls.where("pmod(hash(host), 4) = 0")
        found = urlfilter.train(train)
        n, right = found.judge(test).agg(F.count(F.lit(1)), F.avg((F.col("judged") == F.col("verdict")).cast("double"))).first()
        assert n > 100 and right > 0.97
        assert sum(v > 0.05 for v in found.importances().values()) >= 3


def test_no_feature_knows_a_rule(spark):
    """On the given pages, labels follow from host and path prefix; the trees must not find that out by suffix."""
    urls = urlfilter.featured(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url"))
    importances = urlfilter.train(urls).importances()
    assert sum(v > 0.01 for k, v in importances.items() if not k.startswith("f_suffix")) >= 4
    assert urls.count() == 250 and urls.where("f_suffix_urls IS NULL").count() == 0


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in urlfilter.filtered(pages).collect()} == {"allow"}
    assert urlfilter.filtered(pages.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id bigint, url string")
    assert {r.verdict for r in urlfilter.filtered(one).collect()} == {"block"}
