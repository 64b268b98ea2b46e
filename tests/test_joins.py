"""Joins by time, block and domain against plain loops."""

import ipaddress
import random
from datetime import datetime, timedelta

from metaloom.operators import joins


def test_as_of_equals_a_loop(spark):
    r = random.Random(4)
    begin = datetime(2024, 1, 1)
    at = lambda: begin + timedelta(seconds=r.randrange(400)) if r.random() > 0.05 else None
    left = [(i, r.choice(["a", "a", "a", "b", "c", None]), at()) for i in range(300)]
    left += [(300, "a", left[0][2]), (300, "a", left[0][2])]
    right = [(r.choice(["a", "a", "b", None, "d"]), at(), r.randrange(5)) for _ in range(120)] + [("a", begin + timedelta(seconds=200), 9)] * 2
    wanted = []
    for i, k, t in left:
        before = [(x[1], x[2]) for x in right if x[0] == k and t is not None and x[1] is not None and x[1] <= t]
        wanted.append((i, k, t, max(before, default=(None, None))))
    pages = spark.createDataFrame(left, "id int, url string, at timestamp")
    answers = spark.createDataFrame([(k, t, v) for k, t, v in right], "url string, fetched timestamp, value int")
    for rows in (10**6, 50, 7):
        found = joins.as_of(pages, answers, ["url"], "at", "fetched", slice_rows=rows)
        assert found.columns == ["id", "url", "at", "last"]
        made = [(x.id, x.url, x.at, (x.last.fetched, x.last.value) if x.last else (None, None)) for x in found.collect()]
        assert sorted(made, key=str) == sorted(wanted, key=str)
    assert joins.as_of(pages.limit(0), answers, ["url"], "at", "fetched").count() == 0
    assert joins.as_of(pages, answers.limit(0), ["url"], "at", "fetched").where("last IS NOT NULL").count() == 0


def test_hot_keys_are_cut(spark):
    begin = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", begin + timedelta(seconds=i)) for i in range(1000)] + [("b", begin)] * 3, "_key string, _time timestamp")
    sizes = [x["count"] for x in joins._sliced(rows, 100, joins.Scratch(spark)).groupBy("_key", "_slice").count().collect()]
    assert sum(sizes) == 1003 and len(sizes) == 11 and max(sizes) <= 101


def test_blocks(spark):
    r = random.Random(6)
    blocks = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "0.0.0.0/0", "192.168.0.5-192.168.3.77", "2001:db8::/32", "2001:db8::1-2001:db8::ff", "nonsense", None, "10.0.0.0/8", "10.1.2.9-1.1.1.1"]
    addresses = [f"10.{r.randrange(3)}.{r.randrange(4)}.{r.randrange(5)}" for _ in range(60)] + [f"192.168.{r.randrange(5)}.{r.randrange(256)}" for _ in range(60)]
    addresses += ["2001:db8::1", "[2001:DB8::ff]", "2001:db8::100", "fe80::1%eth0", "::ffff:10.1.2.3", "256.1.1.1", "", None, addresses[0]]

    def holds(block, address):
        try:
            first, dash, last = block.partition("-")
            nets = ipaddress.summarize_address_range(ipaddress.ip_address(first), ipaddress.ip_address(last)) if dash else [ipaddress.ip_network(block)]
            a = ipaddress.ip_address(address.strip("[]").split("%")[0])
            a = getattr(a, "ipv4_mapped", None) or a
            return any(a in n for n in nets if n.version == a.version)
        except (ValueError, AttributeError, TypeError):
            return False

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id int, address string")
    lists = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "n int, block string")
    found = sorted((x.id, x.matched.n) for x in joins.in_blocks(rows, lists).collect())
    assert found == [(i, n) for i, a in enumerate(addresses) for n, b in enumerate(blocks) if holds(b, a)]
    size = lambda b: (int(ipaddress.ip_address(b.split("-")[1])) - int(ipaddress.ip_address(b.split("-")[0])) + 1 if "-" in b else ipaddress.ip_network(b).num_addresses, b)
    best = {x.id: x.block for x in joins.narrowest_block(rows, lists).collect()}
    assert best == {i: min((b for b in blocks if holds(b, a)), key=size, default=None) for i, a in enumerate(addresses)}
    plan = joins.in_blocks(rows, lists)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_domains(spark):
    r = random.Random(8)
    names = ["com", "co.uk", "example.com", "a.example.com", "deep.a.example.com", ".Blog.Example.org.", "org.", "", None]
    hosts = [".".join(r.choice(["a", "b", "blog", "deep", "example", "co", "notexample"]) for _ in range(r.randrange(0, 4))) + r.choice([".com", ".org", ".example.com", ".co.uk", ".net", "COM"]) for _ in range(200)]
    hosts += ["example.com", "EXAMPLE.com.", "com", "", None, hosts[0]]
    clean = [n.lower().strip(".") for n in names if n]

    def longest(host):
        h = (host or "").lower().removesuffix(".")
        return max((d for d in clean if h == d or h.endswith("." + d)), key=len, default=None)

    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id int, host string")
    found = {x.id: x.listed for x in joins.listed_domains(rows, spark.createDataFrame([(n,) for n in names], "domain string")).collect()}
    assert found == {i: longest(h) for i, h in enumerate(hosts)}
