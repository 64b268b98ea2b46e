"""The cache's merges and the reports' sketches."""

from datetime import datetime, timedelta

from metaloom.operators import fetch, reports
from metaloom.operators.cache import PageCache


def test_merges_keep_the_newest_and_touch_only_their_buckets(spark, tmp_path):
    cache = PageCache(spark, f"{tmp_path}/cache", buckets=8)
    at = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    put = lambda rows: cache.put(spark.createDataFrame(rows, "url string, html string, status int, fetched_at timestamp"))
    assert cache.rows().count() == 0 and put([]) == 0
    first = [(f"https://e.example/{i}", f"old {i}", 200, at(1)) for i in range(40)]
    assert put(first) == 8
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    before = files()
    more = [("HTTPS://e.example/3#x", "new 3", 200, at(5)), ("https://e.example/3", "older", 200, at(0)), ("https://e.example/3", "no time", 200, None), ("nonsense", "x", 200, at(9))]
    for _ in range(2):  # the second time nothing changes
        assert put(more) == 1
        found = {r.url: r.html for r in cache.rows().collect()}
        assert len(found) == cache.rows().count() == 40 and found["https://e.example/3"] == "new 3" and found["https://e.example/4"] == "old 4"
    kept = {p for p in files() if p in before and files()[p] == before[p]}
    assert len({p.parent for p in before} - {p.parent for p in kept}) == 1
    wanted = spark.createDataFrame([(1, "https://e.example/3"), (2, "https://e.example/99")], "id int, url string")
    known, unknown = fetch.split_by_cache(wanted, cache.rows())
    assert [(r.id, r.html) for r in known.collect()] == [(1, "new 3")] and [r.id for r in unknown.collect()] == [2]


def test_what_was_followed_goes_into_the_cache(spark, tmp_path):
    answers = spark.createDataFrame([("https://a.example/", 302, "/b", None, None), ("https://a.example/b", 200, None, "text/html", "<p>b")], "request_url string, status int, location string, content_type string, body string")
    followed = fetch.follow(spark.createDataFrame([("https://a.example/",), ("https://gone.example/",)], "url string"), answers)
    cache = PageCache(spark, f"{tmp_path}/cache", buckets=4)
    cache.put(fetch.cache_rows(followed))
    (row,) = cache.rows().collect()
    assert (row.url, row.html, row.final_url, row.status, row.redirects[0].to) == ("https://a.example/", "<p>b", "https://a.example/b", 200, "https://a.example/b")


def test_sketches_add_up(spark):
    rows = spark.range(20_000).selectExpr("id % 3 AS a", "id % 2 AS b", "id % 5000 AS user")
    parts = [reports.counted(rows.where(f"user % 4 = {k}"), ["a", "b"], "user") for k in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = {(r.a, r.b, r.level): (r.n, r.about) for r in reports.cube(reports.added(both, ["a", "b"]), ["a", "b"]).collect()}
    assert len(found) == 6 + 3 + 2 + 1 and found[None, None, 3][0] == 20_000
    assert abs(found[None, None, 3][1] - 5000) < 250 and abs(found[None, 0, 2][1] - 2500) < 125
