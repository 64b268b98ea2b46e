"""What replayed fetching evaluates: nothing twice for each try of a URL."""

from metaloom.functions import urls
from metaloom.operators import adapters, fetch


def test_tries_are_made_and_normalised_once(spark):
    wanted = spark.createDataFrame([(1, "https://www.reddit.com/r/s/comments/p1/t")], "id int, url string")
    responses = spark.createDataFrame([], "request_url string, status int, location string, content_type string, body string")
    plan = fetch.records(wanted, responses).select("id", "ok")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [normalize_url") == 2  # tries with a URL that can be used, and the others
    assert "explode(CASE" in plan and "explode(filter" not in plan


def test_what_the_reddit_adapter_reads_is_found_once(spark):
    made = str(adapters.reddit(adapters.Page()))
    assert made.count("site_text") < 8 and made.count("split(") == 1


def test_normalised_urls_stay_without_being_split():
    urls.split.cache_clear()
    plain = ["https://www.reddit.com/r/s/comments/p1/t.json", "http://a.example/", "https://a.example/x/y.z?q=1&r=[2]?"]
    assert [urls.resolve(u) for u in plain] == [urls.resolve(u, "https://b.example/c") for u in plain] == plain and urls.split.cache_info().misses == 0
    others = {
        "https://A.example/": "https://a.example/", "https://a.example": "https://a.example/", "https://a.example/?": "https://a.example/", "https://a.example/#f": "https://a.example/", "https://a.example/b/../c": "https://a.example/c",
        "https://a.example/b\\c": "https://a.example/b/c", "https://a.example/?q='": "https://a.example/?q=%27", "http://0x7f/": "http://0.0.0.127/", "https://a.example:443/": "https://a.example/", "https://a.0x1/": None,
    }
    assert {u: urls.resolve(u) for u in others} == others
