import pytest
from metaloom.functions.tables import register
from metaloom.operators import adapters, assets, fetch
from metaloom.plans.api import Engine, preview_cards, stripped_json
from metaloom.streaming.pages import read_pages, write_records
from pyspark.sql import functions as F

ARTICLE = """<html><head><title>Fallback title</title><link rel="canonical" href="/stories/launch"><link rel="icon" href="/favicon.ico" sizes="32x32">
<meta name="description" content="Fallback"><meta property="og:type" content="article"><meta property="og:title" content="A launch"><meta property="og:description" content="A useful preview engine for everyone.">
<meta property="og:site_name" content="Example"><meta property="og:image" content="/images/cover.jpg"><meta property="og:image:width" content="1200"><meta property="og:image:height" content="630">
<meta property="article:published_time" content="2026-01-01"><meta name="twitter:card" content="summary"><meta name="twitter:image" content="/images/card.jpg">
<script type="application/ld+json">{"@type":"NewsArticle","headline":"JSON","dateModified":"2026-02-02","author":{"@type":"Person","name":"A. Writer"}}</script></head><body><img src="/s.png" width="80" height="60"></body></html>"""
ZOO = """<link rel="preload" as="image" href="/pre.jpg" imagesrcset="/pre-1x.jpg 1x, /pre-2x.jpg 2x"><img src="/hero.jpg" data-bg="/bg.jpg" srcset="/h-480.jpg 480w, /h-800.jpg 800w" data-srcset="/lazy.jpg 1x">
<picture><source srcset="/p.avif 1x" type="image/avif"><img data-original="/orig.jpg"></picture><video poster="/poster.jpg"></video><noscript><img src="/noscript.jpg"></noscript><img src="data:image/png;base64,x"><img src="/pixel.gif"><img src="/sprite.png"><link rel="icon" href="/favicon.ico">"""
STATE = '<title>x</title><script id="__NEXT_DATA__" type="application/json">{"props":{"post":{"title":"A title from the next data","description":"A description from the data","author":{"name":"Next Author"},"image":"/next/cover.jpg"}}}</script>'
TIKTOK = """<meta property="og:title" content="TikTok - Make Your Day"><script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":{"id":"7000","desc":" A real caption ","createTime":"1767225600",
"author":{"uniqueId":"me","nickname":"Me"},"stats":{"playCount":12345},"video":{"duration":164,"width":576,"height":1024,"cover":"https://p16.tiktokcdn.com/c.jpg","playAddr":"https://v16.tiktok.com/v.mp4"}}}}}}</script>"""
YOUTUBE = """<title>Html title - YouTube</title><script>var ytInitialPlayerResponse = {"videoDetails":{"title":"Player title","shortDescription":"Player text"}};</script>
<script>var ytInitialData = {"contents":[{"playlistVideoRenderer":{"videoId":"a1","title":{"runs":[{"text":"One"}]}}},{"playlistVideoRenderer":{"videoId":"b2","title":{"simpleText":"Two"}}}],"header":{"playlistHeaderRenderer":{"title":{"simpleText":"My list"}}}}</script>"""

PAGES = {
    "article": ("https://example.com/base/page", ARTICLE),
    "plain": ("https://example.com/no-media", "<title>Only a title</title>"),
    "zoo": ("https://example.com/post", ZOO),
    "state": ("https://example.com/next", STATE),
    "tiktok": ("https://www.tiktok.com/@me/video/7000", TIKTOK),
    "tiktok_url": ("https://www.tiktok.com/@photo/photo/9", "<p>x</p>"),
    "video": ("https://www.youtube.com/watch?v=abc", YOUTUBE),
    "list": ("https://www.youtube.com/playlist?list=L", YOUTUBE),
    "reddit": ("https://www.reddit.com/user/me/comments/z/t", '<title>Reddit - Please wait for verification</title><script type="application/json">{"preview":{"images":[{"source":{"url":"https://preview.redd.it/x.jpg","width":1080,"height":1080}}]},"icon":"https://www.redditstatic.com/avatar/big.png"}</script>'),
    "profile": ("https://x.com/me", '<meta property="og:title" content="Me on X">'),
    "broken": ("ftp://example.com/", "<title>t</title>"),
    "none": (None, None),
}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(k, u, h) for k, (u, h) in PAGES.items()]
    found = Engine().parse(spark.createDataFrame(rows, "key string, url string, html string")).cache()
    return {r.key: r for r in found.collect()}


def test_article(records):
    r = records["article"]
    assert (r.ok, r.type, r.title, r.site_name, r.canonical_url) == (True, "article", "A launch", "Example", "https://example.com/stories/launch")
    assert r.best_image == "https://example.com/images/cover.jpg" and r.images[0].source == "openGraph"
    assert r.confidence > 90 and r.completeness > 80 and r.reliability > 70
    assert r.author.name == "A. Writer" and r.article.modifiedTime == "2026-02-02" and r.article.publishedTime == "2026-01-01"
    assert (r.sources.title, r.sources.description, r.sources.image) == ("openGraph", "openGraph", "openGraph")
    assert r.favicons[0].url == "https://example.com/favicon.ico" and r.favicons[0].metadata.sizes == "32x32"
    assert {"parsed Open Graph", "parsed JSON-LD", "selected image from openGraph"} <= set(r.trace) and "og:image" in r.diagnostics.selectedImageReason
    assert r.diagnostics.confidenceBreakdown.structuredData == 100 and r.video is not None


def test_without_media_or_url(records):
    r = records["plain"]
    assert [r.images, r.videos, r.audio, r.favicons] == [[]] * 4 and (r.type, r.completeness) == ("website", 34)
    for k in ("broken", "none"):
        assert (records[k].ok, records[k].type, records[k].confidence, records[k].title) == (False, "unknown", 0, None)


def test_media(records):
    found = {i.url.removeprefix("https://example.com") for i in records["zoo"].images}
    assert {"/pre.jpg", "/pre-1x.jpg", "/hero.jpg", "/bg.jpg", "/h-480.jpg", "/lazy.jpg", "/p.avif", "/orig.jpg", "/poster.jpg", "/noscript.jpg"} <= found
    assert not {"/pixel.gif", "/sprite.png", "/favicon.ico"} & found
    assert len({i.url for i in records["zoo"].images}) == len(found) and all(0 <= i.score <= 100 for i in records["zoo"].images)


def test_state(records):
    r = records["state"]
    assert (r.title, r.description, r.author.name, r.best_image) == ("A title from the next data", "A description from the data", "Next Author", "https://example.com/next/cover.jpg")
    assert {"embeddedData", "nextData", "applicationJson"} <= set(r.diagnostics.sourcesUsed)


def test_sites(records):
    t = records["tiktok"]
    assert (t.type, t.title, t.author.name, t.video.viewCount, t.video.duration, t.video.publishedTime) == ("social_post", "A real caption", "Me", 12345, "164", "2026-01-01T00:00:00.000Z")
    assert "https://p16.tiktokcdn.com/c.jpg" in [i.url for i in t.images] and "https://v16.tiktok.com/v.mp4" in [v.url for v in t.videos]
    assert records["tiktok_url"].title == "TikTok post by @photo" and records["tiktok_url"].diagnostics.extractionMethod == "tiktok:urlFallback"
    v = records["video"]
    assert (v.type, v.title, v.description, v.canonical_url, v.diagnostics.extractionMethod) == ("video", "Player title", "Player text", "https://www.youtube.com/watch?v=abc", "youtube:ytInitialPlayerResponse")
    p = records["list"]
    assert p.type == "playlist" and p.playlist.title == "My list" and [(x.id, x.title) for x in p.playlist.videos] == [("a1", "One"), ("b2", "Two")]
    d = records["reddit"]
    assert (d.type, d.site_name, d.author.name) == ("social_post", "Reddit", "me") and [i.url for i in d.images] == ["https://preview.redd.it/x.jpg"]
    assert (records["profile"].type, records["profile"].site_name) == ("profile", "X")


def test_scoring_example(spark):
    images = F.array(
        assets.asset(F.lit("https://e.com/favicon.ico"), "favicon", "favicon", width=F.lit(32.0), height=F.lit(32.0)),
        assets.asset(F.lit("https://e.com/body.png"), "image", "html", width=F.lit(500.0), height=F.lit(200.0)),
        assets.asset(F.lit("https://e.com/og.jpg"), "image", "openGraph", width=F.lit(1200.0), height=F.lit(630.0)),
    )
    found = spark.range(1).select(assets.scored(images).alias("s")).first().s
    assert [(x.url.rsplit("/", 1)[1], x.score, x.confidence) for x in found] == [("og.jpg", 100.0, 1.0), ("body.png", 47.5, 0.47), ("favicon.ico", 0.0, 0.0)]


def test_cards_json_plugins_and_oembed(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", '<title>t</title><link rel="alternate" type="application/json+oembed" href="/o"><img src="/a.png">')], "title int, url string, html string")
    docs = spark.createDataFrame([("https://e.com/o", '{"type":"photo","url":"https://e.com/photo.jpg","width":1200,"height":630}')], "href string, body string")

    def setup(api):
        api.add_extractor("mine", lambda: adapters.result(title=F.lit("From a plugin")))
        api.add_extractor("bad", lambda: 1 / 0)
        api.add_adapter("own", lambda url: F.contains(url, F.lit("e.com")), lambda page: adapters.result(source=F.lit("own"), siteName=F.lit("Mine")))

    found = Engine([("p", setup)], include_raw=True).use("p", setup).parse(pages.withColumnRenamed("title", "id"), docs)
    r = found.first()
    assert (r.id, r.title, r.site_name, r.sources.title, r.best_image) == (1, "From a plugin", "Mine", "mine", "https://e.com/photo.jpg")
    assert any("bad" in w for w in r.diagnostics.warnings) and r.raw.html.title == "t"
    card = preview_cards(found).first()
    assert (card.domain, card.siteName, card.image) == ("e.com", "Mine", "https://e.com/photo.jpg")
    assert '"description"' not in found.select(stripped_json(found, "title", "description")).first()[0]


def test_fetching(spark):
    post = '[{"data":{"children":[{"kind":"t3","data":{"id":"z","title":"A post","author":"me","permalink":"/r/s/comments/z/","created_utc":1767225600,"gallery_data":{"items":[{"media_id":"b"},{"media_id":"a"}]},"media_metadata":{"a":{"s":{"u":"https://preview.redd.it/a.jpg?w=1&amp;s=2"}},"b":{"s":{"u":"https://preview.redd.it/b.jpg"}}}}}]}}]'
    responses = [
        ("https://www.reddit.com/r/s/comments/z/t.json", 200, None, "application/json", post),
        ("https://www.reddit.com/r/s/comments/y/t.json", 403, None, "text/html", "<p>blocked</p>"),
        ("https://old.reddit.com/r/s/comments/y/t", 200, None, "text/html", "<title>Old page</title>"),
        ("https://www.reddit.com/r/s/comments/w/t.json", 429, None, "text/html", ""),
        ("https://e.com/go", 301, "/page", "text/html", ""),
        ("https://e.com/page", 404, None, "text/html", "<title>Gone</title>"),
        ("https://e.com/x.png", 200, None, "image/png", ""),
        ("https://e.com/loop", 302, "/loop", None, ""),
    ]
    wanted = [(i, u) for i, u in enumerate(("https://www.reddit.com/r/s/comments/z/t", "https://www.reddit.com/r/s/comments/y/t", "https://www.reddit.com/r/s/comments/w/t", "https://e.com/go", "https://e.com/x.png", "https://e.com/loop", "https://e.com/unknown"))]
    found = {r.id: r for r in fetch.records(spark.createDataFrame(wanted, "id int, url string"), spark.createDataFrame(responses, "request_url string, status int, location string, content_type string, body string")).collect()}
    assert (found[0].ok, found[0].title, found[0].type, found[0].method, found[0].author.name) == (True, "A post", "social_post", "reddit:jsonEndpoint", "me")
    assert found[0].best_image == "https://preview.redd.it/b.jpg"
    assert (found[1].title, found[1].method) == ("Old page", "reddit:oldReddit")
    assert [(a.how, a.status, a.blocked) for a in found[1].attempts][:2] == [("reddit:jsonEndpoint", 403, "provider_blocked_request"), ("reddit:oldReddit", 200, None)]
    assert (found[2].ok, found[2].type, found[2].confidence, found[2].method) == (False, "unknown", 0, "reddit:blockedProvider")
    assert (found[3].ok, found[3].title, len(found[3].redirects), found[3].final_url) == (False, "Gone", 1, "https://e.com/page")
    assert (found[4].type, found[4].confidence, found[4].best_image) == ("image", 82, "https://e.com/x.png")
    assert found[5].error.startswith("Too many redirects") and found[6].error.startswith("No response")


def test_ranking_of_rows_equals_ranking_of_arrays(spark):
    kinds = ("openGraph", "html", "favicon", "adapter", "odd")
    rows = [(i % 7, i, f"https://e.com/{'logo' if i % 5 == 0 else 'x'}{i % 4}{'-small' if i % 3 else ''}.{('jpg', 'webp', 'gif')[i % 3]}", kinds[i % 5], float(i * 37 % 900), float(i * 53 % 700)) for i in range(120)]
    df = spark.createDataFrame(rows, "page int, i int, url string, source string, w double, h double").withColumn("a", assets.asset(F.col("url"), "image", F.col("source"), width=F.col("w"), height=F.col("h")))
    df = df.withColumn("at", F.expr("row_number() OVER (PARTITION BY page ORDER BY i) - 1"))
    by_rows = assets.scored_rows(df, "page").select("page", "ord", "a.url", "score").collect()
    arrays = df.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "a"))), lambda x: x.a).alias("images"))
    by_arrays = arrays.select("page", F.posexplode(assets.scored(F.col("images"))).alias("ord", "a")).select("page", "ord", "a.url", "a.score").collect()
    assert sorted(map(tuple, by_rows)) == sorted(map(tuple, by_arrays)) and len(by_rows) == 120


def test_cache_and_limit(spark):
    cache = spark.createDataFrame([("https://e.com:443/a#x", "<p>", "https://e.com/a", None, "text/html")], "url string, html string, final_url string, status int, content_type string")
    hits, misses = fetch.split_by_cache(spark.createDataFrame([(1, "https://E.com/a"), (2, "https://e.com/b")], "id int, url string"), cache)
    assert [(r.id, r.status) for r in hits.collect()] == [(1, 200)] and [r.id for r in misses.collect()] == [2]
    large = fetch.limited(spark.createDataFrame([("u", "x" * 50), ("v", None)], "request_url string, body string"), 10).collect()
    assert [(r.body, r.error is not None) for r in large] == [(None, True), (None, False)]
    followed = fetch.follow(spark.createDataFrame([("https://e.com/b",)], "url string"), spark.createDataFrame([("https://e.com/b", 200, None, "text/html", "hi")], "request_url string, status int, location string, content_type string, body string"))
    assert [(r.url, r.html) for r in fetch.cache_rows(followed).collect()] == [("https://e.com/b", "hi")]


def test_records_apply_cache_limit_and_bytes(spark):
    png, page = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4) + (480).to_bytes(4), "<title>A page</title>"
    responses = [("https://e.com/big", "text/html", page + "x" * 2_000_000, None), ("https://e.com/x.png", "image/png", None, png), ("https://e.com/y.png", "image/png", None, png + b"x" * 2_000_000)]
    responses = spark.createDataFrame([(u, 200, None, *r) for u, *r in responses], "request_url string, status int, location string, content_type string, body string, bytes binary")
    wanted = spark.createDataFrame(list(enumerate(("https://e.com/big", "https://e.com/x.png", "https://e.com/y.png", "https://e.com/kept"))), "id int, url string")
    cache = spark.createDataFrame([("https://e.com/kept", "<title>Kept</title>", "https://e.com/kept", None, "text/html")], "url string, html string, final_url string, status int, content_type string")
    found = {r.id: r for r in fetch.records(wanted, responses, cache=cache).select("id", "ok", "title", "type", "completeness", "error").collect()}
    assert [found[k].error for k in (0, 2)] == ["Response body exceeds 2000000 bytes."] * 2 and not found[0].ok and not found[2].ok
    assert (found[1].type, found[1].completeness) == ("image", 60)  # its size is read from the bytes
    assert (found[3].ok, found[3].title, found[3].error) == (True, "Kept", None)


def test_stream_and_table_function(spark, tmp_path):
    rows = [(i, f"https://e.com/{i}", f"<title>Page {i}</title><img src=/i{i}.png>") for i in range(5)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/in")
    write_records(read_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").select("title").collect()) == [f"Page {i}" for i in range(5)]
    register(spark)
    spark.read.parquet(f"{tmp_path}/in").createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT page_id, m.url FROM some_pages, LATERAL web_media(html, url) m ORDER BY 1").collect()
    assert [r.url for r in found] == [f"https://e.com/i{i}.png" for i in range(5)]
