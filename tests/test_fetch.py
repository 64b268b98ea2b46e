"""Fetching from replayed responses: what is blocked, counted once and said of posts and providers."""

import json

from metaloom.operators import fetch
from metaloom.plans.api import Engine, stripped_json
from metaloom.sources import reddit

RESPONSES = "request_url string, status int, location string, content_type string, body string"


def test_names_without_an_address_are_blocked(spark):
    wanted = spark.createDataFrame([(1, "https://known.example/"), (2, "https://unknown.example/"), (3, "http://10.0.0.1/"), (4, "https://partly.example/")], "id int, url string")
    dns = spark.createDataFrame([("KNOWN.example", "93.184.216.34"), ("partly.example", "93.184.216.34"), ("partly.example", "10.1.1.1"), ("unknown.example", None)], "host string, address string")
    found = {r.id: r.blocked for r in fetch.guarded(wanted, dns).collect()}
    assert found == {1: None, 2: "No address is known for unknown.example", 3: "Private or reserved network address is blocked: 10.0.0.1", 4: "Private or reserved network address is blocked: 10.1.1.1"}
    assert {r.id: r.blocked is None for r in fetch.guarded(wanted).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r.blocked for r in fetch.guarded(wanted, dns, True, True).collect()} == {None}


def test_every_hop_is_checked_and_every_row_comes_once(spark):
    rows = [("https://a.example/", 302, "http://127.0.0.1/x", None, None), ("https://b.example/", 302, "/c", None, None), ("https://b.example/", 404, None, None, "old"), ("https://b.example/c", 200, None, "text/html", "one"), ("https://b.example/c", 200, None, "text/html", "two")]
    found = {r.id: r for r in fetch.follow(spark.createDataFrame([(1, "https://a.example/"), (2, "https://b.example/"), (3, "https://b.example/")], "id int, url string"), spark.createDataFrame(rows, RESPONSES)).collect()}
    assert len(found) == 3 and found[1].error == "Loopback address is blocked: 127.0.0.1"
    assert found[2].body == found[3].body and found[2].status == 200
    timed = spark.createDataFrame([("https://b.example/", 200, None, "text/html", "old", 1), ("https://b.example/", 404, None, "text/html", "new", 2)], RESPONSES + ", fetched_at int")
    assert [(r.status, r.body) for r in fetch.follow(spark.createDataFrame([("https://b.example/",)], "url string"), timed).collect()] == [(404, "new")]


def post(**more):
    return {"title": "T", "id": "p1", "author": "u", "permalink": "r/s/comments/p1/t/", "created_utc": 1767225600, **more}


def test_posts(spark):
    gallery = {"media_metadata": {"a": {"s": {"u": "https://preview.redd.it/a.jpg?x=1&amp;y=2", "x": 900, "y": 600}, "m": "image/jpg"}, "b": {"s": {"gif": "https://i.redd.it/b.gif", "x": 300, "y": 300}}, "small": {"s": {"u": "https://i.redd.it/s.jpg", "x": 100, "y": 90}}}, "gallery_data": {"items": [{"media_id": "b"}, {"media_id": "a"}]}}
    found = reddit.pictures(post(**gallery, thumbnail="https://b.thumbs.redditmedia.com/t.jpg"))
    assert [p["url"] for p in found] == ["https://preview.redd.it/a.jpg?x=1&y=2", "https://i.redd.it/b.gif"] and found[0]["width"] == 900
    preview = {"preview": {"images": [{"resolutions": [{"url": "https://preview.redd.it/1.jpg", "width": 320, "height": 240}, {"url": "https://preview.redd.it/2.jpg", "width": "640", "height": 480}]}]}, "url": "https://i.redd.it/d.jpg"}
    assert [p["url"] for p in reddit.pictures(post(**preview))] == ["https://i.redd.it/d.jpg", "https://preview.redd.it/2.jpg"]
    film = {"secure_media": {"reddit_video": {"fallback_url": "https://v.redd.it/x/DASH_720.mp4?a=1&amp;b", "width": 1280, "height": 720}}}
    assert reddit.videos(post(**film)) == [{"url": "https://v.redd.it/x/DASH_720.mp4?a=1&b", "width": 1280.0, "height": 720.0}]
    for odd in (post(created_utc=1e300, media="x", media_metadata=[1], gallery_data=7, preview={"images": [3, {"source": 5, "resolutions": 1}]}, thumbnail=5, url="http://[bad"), post(title="\\ud800 x", created_utc="soon", selftext=["x"])):
        assert reddit.page_of(json.dumps([odd])).encode()
    assert reddit.page_of(None) is reddit.page_of("[") is reddit.page_of("[" * 100_000) is reddit.page_of('{"a": 1}') is None

    url = "https://www.reddit.com/r/s/comments/p1/t"
    body = json.dumps([{"data": {"children": [{"kind": "t3", "data": post(**gallery, **film, selftext="Some  text")}]}}])
    wanted = spark.createDataFrame([(1, url), (1, url)], "id int, url string")
    r = fetch.records(wanted, spark.createDataFrame([(url + ".json", 200, None, "application/json", body)], RESPONSES)).collect()
    assert len(r) == 2 and r[0].title == "T" and r[0].description == "Some text" and r[0].ok and r[0].provider is None
    assert [v.url for v in r[0].videos] == ["https://v.redd.it/x/DASH_720.mp4?a=1&b"] and r[0].best_image == "https://preview.redd.it/a.jpg?x=1&y=2"
    assert r[0].canonical_url == "https://www.reddit.com/r/s/comments/p1/t/" and (r[0].images[0].width, r[0].images[0].height) == (900.0, 600.0)


def test_blocked_providers_say_when_to_try_again(spark):
    url = "https://www.reddit.com/r/s/comments/p1/t"
    rows = [(url + ".json", 429, None, "text/html", "too many requests", "120"), ("https://old.reddit.com/r/s/comments/p1/t", 200, None, "text/html", "<title>Reddit - Please wait for verification</title>", None), (url, 403, None, "text/html", "no", None)]
    (r,) = fetch.records(spark.createDataFrame([(1, url)], "id int, url string"), spark.createDataFrame(rows, RESPONSES + ", retry_after string")).collect()
    assert not r.ok and r.method == "reddit:blockedProvider" and len(r.attempts) == 3
    assert (r.provider.reason, r.provider.statusCode, r.provider.blocked) == ("provider_verification_required", 200, True)
    assert (r.retry.retryable, r.retry.retryAfter, r.retry.retryAfterMs, r.retry.attempts) == (True, "120", 120_000, 3)
    assert r.retry.reason == "reddit:jsonEndpoint returned 429; reddit:oldReddit returned 200; reddit:htmlFallback returned 403"


def test_bytes_are_decoded_and_pictures_keep_theirs(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    rows = [("https://e.example/p", 200, None, "text/html; charset=iso-8859-1", None, "<title>caf\xe9</title>".encode("latin-1")), ("https://e.example/i", 200, None, "image/png", None, png)]
    found = {r.id: r for r in fetch.records(spark.createDataFrame([(1, "https://e.example/p"), (2, "https://e.example/i")], "id int, url string"), spark.createDataFrame(rows, RESPONSES + ", bytes binary")).collect()}
    assert found[1].title == "caf\xe9" and found[2].type == "image" and (found[2].media.width, found[2].media.height) == (640.0, 480.0)


def test_oembed_documents_and_warnings(spark):
    link = '<link rel="alternate" type="{}" href="{}">'
    kinds = [("application/json+oembed", "/good"), ("text/xml+oembed", "/xml"), ("application/json+oembed", "/none"), ("application/json+oembed", "/bad")]
    pages = spark.createDataFrame([(i, "https://e.example/", "".join(link.format(*k) for k in kinds)) for i in (1, 2, 2)], "id int, url string, html string")
    doc = '{"type":"photo","url":"https://e.example/photo.jpg","width":800,"height":600}'
    docs = spark.createDataFrame([("https://e.example/good", doc), ("https://e.example/good", doc), ("https://e.example/bad", "<html>")], "href string, body string")
    found = Engine().parse(pages, docs).collect()
    assert [r.id for r in sorted(found)] == [1, 2, 2]
    for r in found:
        assert [i.url for i in r.images] == ["https://e.example/photo.jpg"]
        assert r.diagnostics.warnings == ["Skipping non-JSON oEmbed endpoint: https://e.example/xml.", "Could not fetch oEmbed endpoint https://e.example/none: no response", "Could not fetch oEmbed endpoint https://e.example/bad: the response is not JSON"]


def test_stripped_json(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, CAST(array() AS ARRAY<STRING>) AS tags, CAST(array() AS ARRAY<STRING>) AS images, struct(CAST(array() AS ARRAY<INT>) AS x, 2 AS y) AS s, array(struct(CAST(array() AS ARRAY<INT>) AS x, 3 AS z)) AS l")
    assert json.loads(df.select(stripped_json(df).alias("j")).first().j) == {"a": 1, "images": [], "s": {"y": 2}, "l": [{"z": 3}]}
    assert json.loads(df.select(stripped_json(df, "a", "tags").alias("j")).first().j) == {"a": 1}
