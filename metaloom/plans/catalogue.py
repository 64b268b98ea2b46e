"""Every query of the engine by name, and the SQL that states its rows.

The given pages hold hardly any markup, so most queries build pages or assets from relational columns, run the engine on
them, and the SQL states what must come out from the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import images as image_files
from metaloom.functions import urls
from metaloom.functions.shared import shared_folder
from metaloom.functions.ship import ship
from metaloom.functions.spread import spread
from metaloom.operators import adapters, aggregates, assets, fetch, joins, quality, reports, state, tags
from metaloom.operators.cache import PageCache
from metaloom.operators.record import with_media, with_tags
from metaloom.plans.api import Engine, preview_cards
from metaloom.sources.pages import scan
from metaloom.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states its rows."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables of few bytes whose rows become pages or lists of assets.
SMALL = ("customer", "part", "supplier")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in SMALL else rows


def text(*parts) -> Column:
    """Columns and literals put together as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def col(name: str) -> Column:
    return F.col(name)


# ---- pages as they are -------------------------------------------------------------------------------------------------

_PAGES = r"""WITH t AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url,
  nullif(trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '') AS title FROM pages),
c AS (SELECT page_id, url, title, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\.', '') AS site,
  CAST(floor(18 * (CASE WHEN length(title) < 6 THEN length(title) / 6.0 WHEN length(title) > 120 THEN greatest(0.4, 120.0 / length(title)) ELSE 1 END) + 0.5) AS INT) AS confidence FROM t)
"""


@query(_PAGES + "SELECT page_id, title FROM c")
def page_title(spark, d):
    return scan(read(spark, d, "pages"), ["title"]).select("page_id", "title")


@query(_PAGES + "SELECT page_id, url AS final_url, site AS domain FROM c")
def url_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", urls.normalize_url("url").alias("final_url")).withColumn("domain", urls.domain_of(col("final_url")))


@query(_PAGES + "SELECT page_id, title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS image, url, site AS \"siteName\", site AS domain, CAST(NULL AS VARCHAR) AS author, 'website' AS type, confidence FROM c")
def preview_card(spark, d):
    return preview_cards(Engine().parse(read(spark, d, "pages")), "page_id")


@query(_PAGES + "SELECT page_id, confidence, 34 AS completeness, CAST(floor(confidence * 0.45 + 34 * 0.3 + 0.5) AS INT) AS reliability FROM c")
def quality_scores(spark, d):
    return Engine().parse(read(spark, d, "pages")).select("page_id", "confidence", "completeness", "reliability")


@query(_PAGES + "SELECT site AS domain, type, count(*) AS n, sum(confidence) AS confidence_sum FROM (SELECT site, 'website' AS type, confidence FROM c) GROUP BY ROLLUP (site, type)")
def type_by_domain_rollup(spark, d):
    cards = preview_cards(Engine().parse(read(spark, d, "pages")), "page_id")
    return cards.rollup("domain", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence_sum"))


@query(r"""WITH t AS (SELECT page_id, nullif(trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), '') AS title FROM pages)
SELECT page_id, 'html' AS sources_used, 'html' AS title_source, 18 AS n_trace FROM t WHERE title IS NULL UNION ALL SELECT page_id, 'html', 'html', 1 FROM t WHERE title IS NOT NULL""")
def sources_used_pages(spark, d):
    r = Engine().parse(read(spark, d, "pages"))
    return r.select("page_id", F.array_join("diagnostics.sourcesUsed", ",").alias("sources_used"), col("sources.title").alias("title_source"), F.size("trace").alias("n_trace"))


# ---- meta tags and links -----------------------------------------------------------------------------------------------


def part_pages(spark, d) -> DataFrame:
    """Products: Open Graph with two pictures, the second secure, and linked data."""
    k = col("p_partkey")
    head = text(
        '<html><head><title>Part</title><meta property="og:title" content="', col("p_name"), '"><meta property="og:type" content="product"><meta name="og:site_name" content="  ', col("p_brand"), ' ">',
        '<meta property=og:image content="/img/', k, '.jpg"><meta property="og:image:width" content="', col("p_size") * 60, 'px"><meta property="og:image:height" content="', col("p_size") * 20 + 200, '">',
        '<meta property="og:image:url" content="/second/', k, '.png"><meta property="og:image:secure_url" content="https://s.example.com/', k, '.png"><meta property="og:image:alt" content="a &amp; b">',
        '<meta property="OG:title" content="other case"><meta property="og:title" content="second">',
        '<meta name="product:price:amount" content="', col("p_retailprice"), '">',
        '<script type="application/ld+json">{"@context":"https://schema.org","@type":["Thing","Product"],"name":"', col("p_name"), '","brand":{"@type":"Brand","name":"', col("p_brand"), '"},"sku":"', k,
        '","offers":[{"price":"', col("p_retailprice"), '","priceCurrency":"EUR","availability":"https://schema.org/InStock"}],"aggregateRating":{"ratingValue":"4.5 stars","reviewCount":', col("p_size"), '}}</script></head><body></body></html>',
    )
    return read(spark, d, "part").select("p_partkey", text("https://shop.example.com/p/", k).alias("url"), head.alias("html"))


def tagged(pages: DataFrame) -> DataFrame:
    return with_tags(scan(pages, ["final_url", "title", "metas", "links"]))


@query("SELECT p_partkey, p_name AS title, 'product' AS type, p_brand AS site_name, 2 AS n_titles, CAST(p_retailprice AS VARCHAR) AS price FROM part")
def og_fields(spark, d):
    t = tagged(part_pages(spark, d))
    return t.select("p_partkey", col("og.title").alias("title"), col("og.type").alias("type"), col("og.site_name").alias("site_name"), F.size(tags.raw_map(col("og_raw"))["og:title"]).alias("n_titles"), col("og.price").alias("price"))


@query("""SELECT p_partkey, 0 AS ord, 'https://shop.example.com/img/' || p_partkey || '.jpg' AS url, p_size * 60.0 AS width, p_size * 20.0 + 200 AS height, CAST(NULL AS VARCHAR) AS alt FROM part
UNION ALL SELECT p_partkey, 1, 'https://s.example.com/' || p_partkey || '.png', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'a & b' FROM part""")
def og_structured_images(spark, d):
    t = tagged(part_pages(spark, d)).select("p_partkey", F.posexplode("og.images").alias("ord", "a"))
    return t.select("p_partkey", "ord", "a.url", "a.width", "a.height", "a.alt")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://e.example.com/u/' || n_nationkey ELSE NULL END AS url, CASE WHEN n_nationkey % 2 = 0 THEN 10.0 + n_nationkey END AS width FROM nation")
def og_orphan_properties(spark, d):
    k = col("n_nationkey")
    html = text('<meta property="og:image:width" content="', k + 10, '">', F.when(k % 2 == 0, text('<meta property="og:image:url" content="/u/', k, '">')).otherwise('<meta property="og:image:alt" content="x">'))
    t = tagged(read(spark, d, "nation").select("n_nationkey", F.lit("https://e.example.com/").alias("url"), html.alias("html")))
    first = F.get("og.images", F.lit(0))
    return t.select("n_nationkey", first.url.alias("url"), first.width.alias("width"))


def order_pages(spark, d) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    html = text(
        '<meta property="og:type" content="article"><meta property="article:published_time" content="', day, '"><meta property="article:section" content="', col("o_orderpriority"), '">',
        '<meta property="article:tag" content="', col("o_orderstatus"), '"><meta property="article:tag" content="', col("c_mktsegment"), '"><meta property="article:author" content="', col("c_name"), '">',
        '<script type="application/ld+json">{"@type":"NewsArticle","headline":"Order ', col("o_orderkey"), '","author":{"@type":"Person","name":"', col("c_name"), '"},"dateModified":"', day, '","keywords":"', col("c_mktsegment"), ', extra"}</script>',
    )
    joined = read(spark, d, "orders").join(read(spark, d, "customer"), col("o_custkey") == col("c_custkey"))
    return joined.select("o_orderkey", text("https://news.example.com/o/", col("o_orderkey")).alias("url"), html.alias("html"))


_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published, o_orderpriority AS section, o_orderstatus || ',' || c_mktsegment AS tags, c_name AS author {_ORDERS}")
def og_article(spark, d):
    return tagged(order_pages(spark, d)).select("o_orderkey", col("og.published").alias("published"), col("og.section").alias("section"), F.array_join("og.tags", ",").alias("tags"), F.array_join("og.authors", ",").alias("author"))


@query(f"SELECT o_orderkey, 'Order ' || o_orderkey AS headline, c_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS modified, c_mktsegment || ',extra' AS keywords, 'NewsArticle' AS type {_ORDERS}")
def jsonld_nodes(spark, d):
    n = F.get("jsonld", F.lit(0))
    return scan(order_pages(spark, d), ["jsonld"]).select("o_orderkey", n.headline.alias("headline"), F.get(n.authors, 0)["name"].alias("author"), n.modified.alias("modified"), F.array_join(n.keywords, ",").alias("keywords"), F.array_join(n.types, ",").alias("type"))


@query("SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS sku, CAST(p_retailprice AS VARCHAR) AS price, 'EUR' AS currency, 'https://schema.org/InStock' AS availability, '4.5 stars' AS rating, CAST(p_size AS VARCHAR) AS reviews FROM part")
def jsonld_product(spark, d):
    n = state.node_of("Product")
    return scan(part_pages(spark, d), ["jsonld"]).select("p_partkey", n["name"].alias("name"), n.brand["name"].alias("brand"), *[n[k].alias(k) for k in ("sku", "price", "currency", "availability", "rating", "reviews")])


@query("SELECT r_regionkey, 3 + r_regionkey AS n_nodes, CASE WHEN r_regionkey % 2 = 1 THEN 1 ELSE 0 END AS n_warnings, r_name AS organization FROM region")
def jsonld_graph(spark, d):
    k = col("r_regionkey")
    people = F.array_join(F.transform(F.sequence(F.lit(0), k), lambda i: F.concat(F.lit('{"@type":"Person","name":"p'), i.cast("string"), F.lit('"}'))), ",")
    html = text('<script type="application/ld+json"><!-- {"@graph":[', people, ',5,{"@type":"Organization","name":"', col("r_name"), '"}]} --></script>', F.when(k % 2 == 1, '<script type="application/ld+json">{"a":NaN}</script>').otherwise(""))
    n = scan(read(spark, d, "region").select("r_regionkey", "r_name", F.lit("https://e.example.com/").alias("url"), html.alias("html")), ["jsonld", "jsonld_warnings"])
    return n.select("r_regionkey", F.size("jsonld").alias("n_nodes"), F.size("jsonld_warnings").alias("n_warnings"), state.node_of("Organization")["name"].alias("organization"))


def customer_cards(spark, d) -> DataFrame:
    k = col("c_custkey")
    html = text(
        '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="', col("c_name"), '"><meta name="twitter:image:src" content="/b', k, '.jpg"><meta name="twitter:image" content="/a', k, '.jpg">',
        '<meta name="twitter:image1" content="/a', k, '.jpg"><meta property="twitter:image:2" content="/c', k, '.jpg"><meta name="twitter:image:width" content="', k % 500 + 300, '">',
        '<meta name="twitter:player:stream" content="/stream.mp4">', F.when(k % 3 == 0, text('<meta name="twitter:player" content="/player/', k, '">')).otherwise(""),
    )
    return read(spark, d, "customer").select("c_custkey", text("https://x.example.com/", k).alias("url"), html.alias("html"))


@query("""SELECT c_custkey, ord, 'https://x.example.com/' || l || c_custkey || '.jpg' AS url, c_custkey % 500 + 300.0 AS width FROM customer, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(ord, l)""")
def twitter_images(spark, d):
    t = tagged(customer_cards(spark, d)).select("c_custkey", F.posexplode("card.images").alias("ord", "a"))
    return t.select("c_custkey", "ord", "a.url", "a.width")


@query("SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_players, CASE WHEN c_custkey % 3 = 0 THEN 'https://x.example.com/player/' || c_custkey END AS player FROM customer")
def twitter_player(spark, d):
    return tagged(customer_cards(spark, d)).select("c_custkey", col("card.title").alias("title"), F.size("card.videos").alias("n_players"), F.get("card.videos", F.lit(0)).url.alias("player"))


def supplier_pages(spark, d) -> DataFrame:
    k = col("s_suppkey")
    html = text(
        '<head><title> ', col("s_name"), ' &amp;\n more</title><link rel="canonical" href="/first"><LINK REL="Shortcut  ICON" href=fav', k, '.ico sizes="16x16"><link rel="apple-touch-icon" href="/t.png">',
        '<link rel="canonical" href="../c/', k, '?a=1#f"><link rel="alternate" hreflang="de" href="/de/', k, '"><link rel="image_src" href="/i.png"><link rel=manifest href="/m.json">',
        '<meta name="description" content="  Supplier\n', k, ' "><meta name="keywords" content="a, ,b , ', k, '"><meta name="robots" content="noindex"><meta name="theme-color" content="#fff"><meta name="application-name" content="App', k, '"></head>',
    )
    return read(spark, d, "supplier").select("s_suppkey", text("https://sup.example.com/a/b/", k).alias("url"), html.alias("html"))


@query("""SELECT s_suppkey, s_name || ' & more' AS title, 'Supplier ' || s_suppkey AS description, '../c/' || s_suppkey || '?a=1#f' AS raw_canonical, 'https://sup.example.com/a/c/' || s_suppkey || '?a=1' AS canonical, 'a,b,' || s_suppkey AS keywords,
'noindex' AS robots, '/m.json' AS manifest, '#fff' AS theme, 'App' || s_suppkey AS app, 'https://sup.example.com/i.png' AS image_src FROM supplier""")
def html_head(spark, d):
    h = col("html")
    return tagged(supplier_pages(spark, d)).select(
        "s_suppkey", h.title.alias("title"), h.description.alias("description"), h.rawCanonicalUrl.alias("raw_canonical"), h.canonicalUrl.alias("canonical"), F.array_join(h.keywords, ",").alias("keywords"), h.robots.alias("robots"),
        h.manifestUrl.alias("manifest"), h.themeColor.alias("theme"), h.applicationName.alias("app"), F.get(h.imageSrc, 0).url.alias("image_src"),
    )


@query("""SELECT s_suppkey, 'icon' AS kind, 'https://sup.example.com/a/b/fav' || s_suppkey || '.ico' AS url, '16x16' AS note FROM supplier UNION ALL SELECT s_suppkey, 'icon', 'https://sup.example.com/t.png', NULL FROM supplier
UNION ALL SELECT s_suppkey, 'alternate', '/de/' || s_suppkey, 'de' FROM supplier""")
def html_links(spark, d):
    t = tagged(supplier_pages(spark, d))
    icons = t.select("s_suppkey", F.lit("icon").alias("kind"), F.explode("html.favicons").alias("a")).select("s_suppkey", "kind", "a.url", col("a.metadata.sizes").alias("note"))
    return icons.unionByName(t.select("s_suppkey", F.lit("alternate").alias("kind"), F.explode("html.alternates").alias("a")).select("s_suppkey", "kind", col("a.href").alias("url"), col("a.hreflang").alias("note")))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'https://n.example.com/o?id=' || n_nationkey WHEN 1 THEN 'https://n.example.com/e?format=json&u=' || n_nationkey END AS href FROM nation""")
def oembed_links(spark, d):
    k = col("n_nationkey")
    link = (
        F.when(k % 4 == 0, text('<link rel="alternate" type="application/json+oembed" href="/o?id=', k, '" title="t">'))
        .when(k % 4 == 1, text('<link rel="next" href="/e?format=json&amp;u=', k, '">'))
        .when(k % 4 == 2, '<link rel="alternate" type="application/rss+xml" href="/feed">')
        .otherwise('<link rel="alternate" type="text/xml+oembed" href="mailto:a@b">')
    )
    return tagged(read(spark, d, "nation").select("n_nationkey", F.lit("https://n.example.com/").alias("url"), link.alias("html"))).select("n_nationkey", F.get("oembed_links", F.lit(0)).href.alias("href"))


# ---- application state -------------------------------------------------------------------------------------------------


def event_pages(spark, d) -> DataFrame:
    k = col("event_id")
    html = text(
        '<script>var a=1;window.__INITIAL_STATE__ = {"post":{"title":"Event number ', k, ' of type ', col("event_type"), '","views":"', (k % 1000).cast("int"), ' views","author":{"name":"user', col("user_id"), '"}},"s":"}{"};more()</script>',
        '<script type="application/json" id="props">', col("props"), '</script><script type="application/json">[1]</script><script type="application/json">{bad</script>',
    )
    return read(spark, d, "events").select("event_id", text("https://ev.example.com/", k).alias("url"), html.alias("html"))


@query("""SELECT event_id, 'initialState:window.__INITIAL_STATE__,initialState:__INITIAL_STATE__,applicationJson:props' AS items, 1 AS n_warnings, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def embedded_items(spark, d):
    named = F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e.source, e.path)), ",")
    props = F.get(F.filter("embedded", lambda e: e.path == "props"), 0)
    return scan(event_pages(spark, d), ["embedded", "embedded_warnings"]).select("event_id", named.alias("items"), F.size("embedded_warnings").alias("n_warnings"), F.get_json_object(props.json, "$.k").alias("k"))


@query("SELECT event_id, 'Event number ' || event_id || ' of type ' || event_type AS title, 'user' || user_id AS author, CAST(event_id % 1000 AS DOUBLE) AS views FROM events")
def embedded_best_string(spark, d):
    from metaloom.functions.js import number_of

    return scan(event_pages(spark, d), ["walk"]).select("event_id", state.best_text("title", "headline", "name").alias("title"), state.first_entity("author")["name"].alias("author"), number_of(state.best_text("viewCount", "views")).alias("views"))


@query("""SELECT c_custkey, 'T' || c_custkey AS title, CASE WHEN c_custkey % 6 IN (0, 3) THEN 1 ELSE 0 END AS n_nodes, CASE WHEN c_custkey % 6 = 0 THEN chr(65533) || ' x' END AS name, CASE WHEN c_custkey % 6 = 1 THEN 'half ' || chr(65533) END AS state_title,
CASE WHEN c_custkey % 6 = 4 THEN 1 ELSE 0 END AS n_warnings, CASE WHEN c_custkey % 6 = 2 THEN 1 ELSE 0 END AS n_images, CASE WHEN c_custkey % 6 = 2 THEN TRUE END AS endless FROM customer""")
def hostile_pages(spark, d):
    """Halves of surrogate pairs, numbers, keys, widths and ports of thousands of digits, JSON that is nested too deeply, and elements that stay open."""
    k = col("c_custkey")
    nines = "9" * 5000
    shapes = [
        '<script type="application/ld+json">{"name":"\\ud800 x"}</script>', f'<script>window.__INITIAL_STATE__ = {{"{nines}":1,"title":"half \\udc00"}}</script>',
        f'<img src="/a.jpg" width="{nines}"><img src="https://e.example.com:{nines}/b.jpg">', f'<script type="application/ld+json">{{"reviewCount":{nines}}}</script>', f'<script type="application/ld+json">{"[" * 100_000}</script>',
        "<video>" * 2000 + "</p>" * 2000,
    ]
    html = text("<title>T", k, "</title>", F.get(F.array(*map(F.lit, shapes)), (k % 6).cast("int")))
    pages = read(spark, d, "customer").select("c_custkey", F.lit("https://e.example.com/").alias("url"), html.alias("html"))
    image = F.get("dom_images", F.lit(0))
    return scan(pages, ["title", "jsonld", "jsonld_warnings", "walk", "dom_images"]).select(
        "c_custkey", "title", F.size("jsonld").alias("n_nodes"), F.get("jsonld", F.lit(0))["name"].alias("name"), state.best_text("title").alias("state_title"),
        F.size("jsonld_warnings").alias("n_warnings"), F.size("dom_images").alias("n_images"), (image.width == float("inf")).alias("endless"),
    )


# ---- media in markup ---------------------------------------------------------------------------------------------------

_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos FROM lineitem"


def gallery(spark, d) -> DataFrame:
    """One page for each order: a picture for each line, one of three sizes, one lazy copy, and two that are to be dropped."""
    line = text('<img src="/g/', col("l_partkey"), "-", col("l_suppkey"), "-", col("at"), '.jpg" width="', (col("l_quantity") * 10).cast("int"), '" height="200" alt="q">')
    lines = read(spark, d, "lineitem").withColumn("at", F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1"))
    pages = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col("at"), line.alias("t")))), lambda x: x.t), "").alias("t"))
    html = text('<link rel="preload" as="image" href="/pre.webp">', col("t"), '<img src="sprite.png"><img data-src="/lazy.jpg" srcset="/s1.jpg 1x, /s2.jpg 2x"><img src="/x.gif" width=1 height=1><picture><source srcset="/p.avif" type="image/avif"></picture><noscript><img src="/ns.png"></noscript>')
    return pages.select("l_orderkey", text("https://g.example.com/o/", col("l_orderkey")).alias("url"), html.alias("html"))


@query(f"""WITH l AS ({_LINES}), n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1)
SELECT l_orderkey, 0 AS ord, 'https://g.example.com/pre.webp' AS url, CAST(NULL AS DOUBLE) AS width, 'link.preload' AS origin FROM n
UNION ALL SELECT l_orderkey, 1 + pos, 'https://g.example.com/g/' || l_partkey || '-' || l_suppkey || '-' || pos || '.jpg', floor(l_quantity * 10), 'img' FROM l
UNION ALL SELECT l_orderkey, 1 + n + k, 'https://g.example.com/' || f, NULL, o FROM n, (VALUES (0, 'lazy.jpg', 'img'), (1, 's1.jpg', 'img'), (2, 's2.jpg', 'img'), (3, 'p.avif', 'picture.source'), (4, 'ns.png', 'noscript')) v(k, f, o)""")
def image_candidates(spark, d):
    t = scan(gallery(spark, d), ["dom_images"]).select("l_orderkey", F.posexplode("dom_images").alias("ord", "a"))
    return t.select("l_orderkey", "ord", "a.url", "a.width", col("a.metadata.discoveredFrom").alias("origin"))


def by_kind(scanned: DataFrame, **kinds: str) -> DataFrame:
    """Each part's media with kind and ord, from one pass over its page."""
    lists = F.array(*[F.struct(F.lit(kind).alias("kind"), col(c).alias("l")) for kind, c in kinds.items()])
    return scanned.select("p_partkey", F.explode(lists).alias("k")).select("p_partkey", "k.kind", F.posexplode("k.l").alias("ord", "a"))


@query("""SELECT p_partkey, kind, ord, url, type FROM part, LATERAL (VALUES ('video', 0, 'https://v.example.com/a' || p_partkey || '.mp4', NULL), ('video', 1, 'https://v.example.com/b.webm', 'video/webm'), ('video', 2, 'https://player.example.com/' || p_partkey, NULL),
('audio', 0, 'https://v.example.com/s' || p_partkey || '.mp3', 'audio/mpeg')) v(kind, ord, url, type)""")
def video_audio_candidates(spark, d):
    k = col("p_partkey")
    html = text('<video data-src="/a', k, '.mp4" poster="/p.jpg" width=640><source src="/b.webm" type="video/webm"></video><audio><source src="/s', k, '.mp3" type="audio/mpeg"></audio><iframe src="https://player.example.com/', k, '"><img src="/no.jpg"></iframe><iframe src="/other"></iframe>')
    t = scan(read(spark, d, "part").select("p_partkey", F.lit("https://v.example.com/x").alias("url"), html.alias("html")), ["dom_videos", "dom_audio"])
    return by_kind(t, video="dom_videos", audio="dom_audio").select("p_partkey", "kind", "ord", "a.url", "a.type")


@query("SELECT p_partkey, ord, 'https://v.example.com/' || CASE ord WHEN 0 THEN 'a' || p_partkey || '.jpg' WHEN 1 THEN 'd/b.jpg' ELSE 'd/c.jpg' END AS url FROM part, (VALUES (0), (1), (2)) v(ord)")
def srcset_split(spark, d):
    """Sets of pictures as the page scan splits them."""
    html = text('<img srcset="/a', col("p_partkey"), '.jpg 1x,  b.jpg\t640w ,, c.jpg, , data:x 2x">')
    found = scan(read(spark, d, "part").select("p_partkey", F.lit("https://v.example.com/d/x").alias("url"), html.alias("html")), ["dom_images"])
    return found.select("p_partkey", F.posexplode("dom_images").alias("ord", "a")).select("p_partkey", "ord", "a.url")


@query("""WITH p AS (SELECT p_partkey AS k FROM part), m AS (SELECT k, kind, unnest(CASE kind WHEN 'image' THEN [{'o': 0, 'u': '/thumb' || k || '.jpg', 's': 'jsonLd', 'w': NULL::DOUBLE, 'alt': NULL}, {'o': 1, 'u': '/thumb' || k || '.jpg', 's': 'jsonScript', 'w': NULL, 'alt': NULL}, {'o': 2, 'u': '/deep/image.png', 's': 'applicationJson', 'w': 640.0, 'alt': 'A deep one'},
  {'o': 3, 'u': '/deep/image.png', 's': 'applicationJson', 'w': 640.0, 'alt': NULL}, {'o': 4, 'u': '/list/photo-1.webp', 's': 'applicationJson', 'w': NULL, 'alt': NULL}, {'o': 5, 'u': '/list/photo-2.webp', 's': 'applicationJson', 'w': 320.0, 'alt': NULL}, {'o': 6, 'u': '/set/card-1.jpg', 's': 'applicationJson', 'w': NULL, 'alt': NULL},
  {'o': 7, 'u': '/set/card-2.jpg', 's': 'applicationJson', 'w': NULL, 'alt': NULL}, {'o': 8, 'u': '/own/cover.jpg', 's': 'applicationJson', 'w': 100.0, 'alt': 'Own'}]
  WHEN 'video' THEN [{'o': 0, 'u': '/clip' || k || '.mp4', 's': 'jsonLd', 'w': NULL, 'alt': NULL}, {'o': 1, 'u': '/clip' || k || '.mp4', 's': 'jsonScript', 'w': NULL, 'alt': NULL}, {'o': 2, 'u': '/play.m3u8', 's': 'applicationJson', 'w': NULL, 'alt': NULL}] ELSE [{'o': 0, 'u': '/pod' || k || '.mp3', 's': 'applicationJson', 'w': NULL, 'alt': NULL}] END) AS x FROM p, (VALUES ('image'), ('video'), ('audio')) v(kind))
SELECT k AS p_partkey, kind, x.o AS ord, 'https://v.example.com' || x.u AS url, x.s AS source, x.w AS width, x.alt AS alt FROM m""")
def json_media(spark, d):
    """Media of linked data and of application data: texts, lists, records, records in records and sets."""
    k = col("p_partkey")
    html = text(
        '<script type="application/ld+json">{"@type":"VideoObject","thumbnailUrl":"/thumb', k, '.jpg","contentUrl":"/clip', k, '.mp4"}</script><script type="application/json">{"image":{"source":{"url":"/deep/image.png","width":"640"},"caption":"A deep one"},'
        '"images":["/list/photo-1.webp",{"src":"/list/photo-2.webp","width":320},"javascript:x","plain"],"poster":{"srcset":"/set/card-1.jpg 1x, /set/card-2.jpg 2x, /sprite.png 3x"},"item":{"coverImageUrl":"/own/cover.jpg","width":100,"alt":"Own"},'
        '"playbackUrl":"/play.m3u8","podcastUrl":"/pod', k, '.mp3","videoTitle":"no media"}</script>',
    )
    t = scan(read(spark, d, "part").select("p_partkey", F.lit("https://v.example.com/x").alias("url"), html.alias("html")), ["json_images", "json_videos", "json_audio"])
    return by_kind(t, image="json_images", video="json_videos", audio="json_audio").select("p_partkey", "kind", "ord", "a.url", "a.source", "a.width", "a.alt")


# ---- URLs --------------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, ref, CASE ref WHEN 'a/../b' THEN 'https://n.example.com/d/' || n_nationkey || '/b' WHEN '/x y' THEN 'https://n.example.com/x%20y' WHEN '?q' THEN 'https://n.example.com/d/' || n_nationkey || '/f?q' WHEN '//H.COM:443/p#f' THEN 'https://h.com/p'
WHEN 'HTTP://U.com:80' THEN 'http://u.com/' WHEN '#top' THEN 'https://n.example.com/d/' || n_nationkey || '/f?z' END AS resolved FROM nation, (VALUES ('a/../b'), ('/x y'), ('?q'), ('//H.COM:443/p#f'), ('HTTP://U.com:80'), ('#top'), ('mailto:a@b'), ('http://')) v(ref)""")
def resolve_url(spark, d):
    refs = F.explode(F.array(*map(F.lit, ("a/../b", "/x y", "?q", "//H.COM:443/p#f", "HTTP://U.com:80", "#top", "mailto:a@b", "http://"))))
    base = text("https://n.example.com/d/", col("n_nationkey"), "/f?z#y")
    return read(spark, d, "nation").select("n_nationkey", refs.alias("ref"), base.alias("base")).select("n_nationkey", "ref", urls.resolve_url("ref", "base").alias("resolved"))


@query("""SELECT n_nationkey, CASE n_nationkey % 7 WHEN 0 THEN 'Pinterest' WHEN 1 THEN 'Reddit' WHEN 2 THEN 'X' WHEN 3 THEN 'Bitly' WHEN 4 THEN 'TinyURL' WHEN 5 THEN 'YouTube' END AS provider, n_nationkey % 7 < 6 AS is_short FROM nation""")
def short_url(spark, d):
    hosts = F.array(*map(F.lit, ("pin.it", "redd.it", "T.co", "www.bit.ly", "tinyurl.com", "youtu.be", "xpin.it")))
    url = text("https://", F.get(hosts, (col("n_nationkey") % 7).cast("int")), "/", col("n_nationkey"))
    return read(spark, d, "nation").select("n_nationkey", urls.short_provider(url).alias("provider")).withColumn("is_short", col("provider").isNotNull())


_IPS = ("127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.1.1", "0.0.0.0", "224.0.0.1", "100.64.0.1", "192.0.2.1", "198.18.0.1", "8.8.8.8", "::1", "fd00::1", "fe80::1", "::ffff:10.0.0.1", "2001:db8::1", "300.1.1.1", "example.com", "::")


@query("SELECT c_custkey, CASE c_custkey % 20 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'private' WHEN 4 THEN 'private' WHEN 5 THEN 'linkLocal' WHEN 6 THEN 'reserved' WHEN 7 THEN 'reserved' WHEN 8 THEN 'reserved' WHEN 9 THEN 'reserved' WHEN 10 THEN 'reserved' WHEN 12 THEN 'loopback' WHEN 13 THEN 'private' WHEN 14 THEN 'linkLocal' WHEN 15 THEN 'reserved' WHEN 19 THEN 'reserved' ELSE 'public' END AS class FROM customer")
def classify_ip(spark, d):
    return read(spark, d, "customer").select("c_custkey", urls.ip_class(F.get(F.array(*map(F.lit, _IPS)), (col("c_custkey") % 20).cast("int"))).alias("class"))


_SOCIAL = ("https://www.youtube.com/watch?v=v{}&list=L", "https://www.reddit.com/r/sub/comments/p{}/t", "https://www.pinterest.com/pin/{}/", "https://www.behance.net/gallery/{}/x", "https://www.tiktok.com/@user/video/{}", "https://www.facebook.com/page/posts/{}", "https://x.com/user/status/{}", "https://www.instagram.com/reel/{}/")


def social_url() -> Column:
    k = col("c_custkey")
    made = [text(*[p for pair in zip(u.split("{}"), [k, ""], strict=False) for p in pair]) for u in _SOCIAL]
    return F.get(F.array(*made), (k % 8).cast("int"))


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'youtubeAdapter' WHEN 1 THEN 'redditAdapter' WHEN 2 THEN 'pinterestAdapter' WHEN 3 THEN 'behanceAdapter' WHEN 4 THEN 'tiktokAdapter' WHEN 5 THEN 'facebookAdapter' WHEN 6 THEN 'twitterAdapter' ELSE 'instagramAdapter' END AS adapter FROM customer""")
def host_route(spark, d):
    url = social_url()
    route = F.coalesce(*[F.when(test(url), F.lit(name)) for name, test, _ in adapters.DEFAULT])
    return read(spark, d, "customer").select("c_custkey", route.alias("adapter"))


@query("""SELECT c_custkey, 'v' || c_custkey AS watch, 's' || c_custkey AS short, 'b' || c_custkey AS be, CAST(NULL AS VARCHAR) AS none FROM customer""")
def youtube_ids(spark, d):
    k = col("c_custkey")
    made = {"watch": text("https://www.youtube.com/watch?a=1&v=v", k, "&b"), "short": text("https://youtube.com/shorts/s", k), "be": text("https://youtu.be/b", k, "?t=1"), "none": text("https://www.youtube.com/@c", k)}
    return read(spark, d, "customer").select("c_custkey", *[urls.youtube_id(u).alias(n) for n, u in made.items()])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS subreddit, CASE c_custkey % 3 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 'q' || c_custkey END AS post_id, CASE WHEN c_custkey % 3 = 2 THEN 'u' || c_custkey END AS username, c_custkey % 3 < 2 AS is_post FROM customer""")
def reddit_url_parts(spark, d):
    k = col("c_custkey")
    url = F.when(k % 3 == 0, text("https://old.reddit.com/r/s", k, "/comments/p", k, "/x")).when(k % 3 == 1, text("https://redd.it/q", k)).otherwise(text("https://www.reddit.com/user/u", k, "/about"))
    of = adapters.reddit_parts(url)
    return read(spark, d, "customer").select("c_custkey", of["subreddit"].alias("subreddit"), of["postId"].alias("post_id"), of["username"].alias("username"), F.coalesce(of["isPost"], F.lit(False)).alias("is_post"))


# ---- assets: merging and ranking ---------------------------------------------------------------------------------------

_ASSETS = """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, 'https://m.example.com/' || (l_partkey % 3) || CASE WHEN l_suppkey % 2 = 0 THEN '-300x200' ELSE '' END || '.jpg' AS url,
CASE l_linenumber % 4 WHEN 0 THEN 'openGraph' WHEN 1 THEN 'html' WHEN 2 THEN 'jsonLd' ELSE 'odd' END AS source, l_quantity * 40.0 AS width, 300.0 AS height, l_partkey % 3 AS sig FROM lineitem"""


def line_asset() -> Column:
    url = text("https://m.example.com/", col("l_partkey") % 3, F.when(col("l_suppkey") % 2 == 0, "-300x200").otherwise(""), ".jpg")
    source = F.get(F.array(*map(F.lit, ("openGraph", "html", "jsonLd", "odd"))), (col("l_linenumber") % 4).cast("int"))
    return assets.asset(url, "image", source, width=col("l_quantity") * 40, height=F.lit(300.0))


def line_assets(spark, d) -> DataFrame:
    one = line_asset()
    rows = read(spark, d, "lineitem")
    sorted_ = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", one.alias("a"))))
    return rows.groupBy("l_orderkey").agg(F.transform(sorted_, lambda x: x.a).alias("images"))


@query(f"""WITH a AS ({_ASSETS}), r AS (SELECT *, CASE source WHEN 'openGraph' THEN 1420 WHEN 'html' THEN 40 WHEN 'jsonLd' THEN 70 ELSE 50 END AS rank FROM a),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, sig ORDER BY rank DESC, pos) AS k, min(pos) OVER (PARTITION BY l_orderkey, sig) AS place FROM r)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS ord, url, source, width FROM b WHERE k = 1""")
def media_dedupe(spark, d):
    t = line_assets(spark, d).select("l_orderkey", F.posexplode(assets.merged(col("images"))).alias("ord", "a"))
    return t.select("l_orderkey", col("ord").cast("bigint").alias("ord"), "a.url", "a.source", "a.width")


_POINTS = """(CASE source WHEN 'openGraph' THEN 94 WHEN 'html' THEN 42 WHEN 'jsonLd' THEN 82 ELSE 50 END
 + CASE WHEN width < 120 THEN -35 WHEN width * height >= 1000000 THEN 12 WHEN width * height >= 300000 THEN 9 WHEN width * height >= 90000 THEN 5 WHEN width * height < 10000 THEN -20 ELSE 0 END
 + CASE WHEN abs(width / height - 1.91) <= 0.18 THEN 12 WHEN abs(width / height - 16.0::DOUBLE / 9) <= 0.2 OR abs(width / height - 1) <= 0.2 THEN 8 WHEN width / height > 4 OR width / height < 0.25 THEN -16 ELSE 0 END + 3
 - least(pos * 1.5, 10) + CASE WHEN n = 1 THEN 4 ELSE 0 END - CASE WHEN same > 1 THEN least((same - 1) * 4, 12) ELSE 0 END)"""
_SCORED = f"WITH a AS ({_ASSETS}), c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, count(*) OVER (PARTITION BY l_orderkey, sig) AS same FROM a), s AS (SELECT *, CAST(greatest(0, least(100, {_POINTS})) AS DOUBLE) AS score, CASE source WHEN 'openGraph' THEN 94 WHEN 'html' THEN 42 WHEN 'jsonLd' THEN 82 ELSE 50 END AS weight FROM c)"


def scored_lines(spark, d) -> DataFrame:
    """The lines of orders as candidates of one page each, ranked."""
    at = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1").alias("at")
    return assets.scored_rows(read(spark, d, "lineitem").select("l_orderkey", at, line_asset().alias("a")), "l_orderkey")


@query(_SCORED + " SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, weight DESC, width * height DESC, pos) - 1 AS ord, url, source, score FROM s")
def score_images(spark, d):
    return scored_lines(spark, d).select("l_orderkey", col("ord").cast("bigint").alias("ord"), "a.url", "a.source", "score")


@query(_SCORED + ", b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, weight DESC, width * height DESC, pos) AS k FROM s) SELECT l_orderkey, url, score, CAST(same > 1 AS BOOLEAN) AS repeated FROM b WHERE k = 1")
def best_image(spark, d):
    repeated = F.exists("reasons", lambda r: r.startswith("duplicate-like"))
    return scored_lines(spark, d).where("ord = 0").select("l_orderkey", "a.url", "score", repeated.alias("repeated"))


_WHY = """'source ' || CASE source WHEN 'openGraph' THEN 'og:image' WHEN 'jsonLd' THEN 'JSON-LD' ELSE source END || ' added ' || weight || ' base points' || CASE WHEN same > 1 THEN '; duplicate-like URL group subtracted ' || least((same - 1) * 4, 12) || ' points' ELSE '' END"""


@query(f"""{_SCORED.replace("l_orderkey, row_number", "l_orderkey, l_suppkey, row_number", 1)}, w AS (SELECT *, {_WHY} AS why FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, url, why) AS k, count(*) OVER (PARTITION BY l_suppkey) AS total FROM w)
SELECT 's' || l_suppkey || '.example.com' AS domain, total AS n, score, url, why FROM b WHERE k = 1""")
def domain_pictures(spark, d):
    """The best picture of all pages of a domain, with the reasons for its base points and for those that repeats cost."""
    at = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1").alias("at")
    page = text("https://www.s", col("l_suppkey"), ".example.com/o/", col("l_orderkey"))
    rows = assets.scored_rows(read(spark, d, "lineitem").select("l_orderkey", at, urls.domain_of(page).alias("domain"), line_asset().alias("a")), "l_orderkey")
    why = F.array_join(F.filter("reasons", lambda r: r.startswith("source ") | r.startswith("duplicate-like ")), "; ")
    best = aggregates.aggregated(rows.select("domain", aggregates.candidate(col("a.url"), col("score"), why).alias("best")), ["domain"], "best", aggregates.best_picture)
    return best.select("domain", "best.*")


@query("""SELECT p_partkey, 1 AS n, CASE WHEN p_size % 5 = 0 THEN 'https://preview.redd.it/b.jpg' ELSE 'https://i.redd.it/a' || p_partkey || '.jpg' END AS first FROM part""")
def reddit_filter(spark, d):
    big = F.when(col("p_size") % 5 == 0, 100.0).otherwise(900.0)
    images = F.array(
        assets.asset(F.lit("https://www.redditstatic.com/avatar.png"), "image", "html"), assets.asset(text("https://i.redd.it/a", col("p_partkey"), ".jpg"), "image", "applicationJson", width=big, height=big),
        assets.asset(F.lit("https://preview.redd.it/b.jpg"), "image", F.when(col("p_size") % 5 == 0, "html").otherwise("html")), assets.asset(F.lit("https://preview.redd.it/b.jpg"), "image", F.when(col("p_size") % 5 == 0, "fallback").otherwise("twitter")),
    )
    kept = assets.reddit_filtered(assets.merged(images))
    return read(spark, d, "part").select("p_partkey", F.size(kept).alias("n"), F.get(F.transform(F.array_sort(F.transform(kept, lambda a: a.url)), lambda u: u), 0).alias("first"))


@query("""SELECT p_partkey, ord, 'https://i.redd.it/' || CASE WHEN p_partkey % 2 = 0 THEN substr('zym', ord + 1, 1) ELSE substr('mzy', ord + 1, 1) END || p_partkey || '.jpg' AS url FROM part, (VALUES (0), (1), (2)) v(ord)""")
def reddit_filter_order(spark, d):
    """A post's pictures of one priority stay in the order of their candidates, but for larger ones."""
    k = col("p_partkey")
    large = F.when(k % 2 == 1, 900.0)
    images = F.array(*[assets.asset(text(f"https://i.redd.it/{name}", k, ".jpg"), "image", "openGraph", **({"width": large, "height": large} if name == "m" else {})) for name in "zym"])
    return read(spark, d, "part").select("p_partkey", F.posexplode(assets.reddit_filtered(images)).alias("ord", "a")).select("p_partkey", "ord", "a.url")


@query("""WITH u AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'https://e.example.com/x' WHEN 1 THEN 'https://e.example.com/cover' WHEN 2 THEN 'https://e.example.com/hero-preview-large' WHEN 3 THEN 'https://e.example.com/og/card/media/share/social' WHEN 4 THEN 'https://i.ytimg.com/vi/abc/maxresdefault' ELSE 'https://pbs.twimg.com/media/q' END AS url, [0, 4, 12, 14, 16, 12][p_partkey % 6 + 1] AS hints FROM part)
SELECT p_partkey, hints, CASE p_partkey % 6 WHEN 1 THEN 'URL matched preview hints (cover) and added 4 points' WHEN 2 THEN 'URL matched preview hints (hero, preview, large) and added 12 points' WHEN 3 THEN 'URL matched preview hints (og, card, media, share, social) and added 14 points'
WHEN 4 THEN 'URL matched preview hints (maxres) and added 4 points' WHEN 5 THEN 'URL matched preview hints (media) and added 4 points' END AS reason, CASE p_partkey % 6 WHEN 4 THEN 'YouTube platform thumbnail added 12 points' WHEN 5 THEN 'social platform media host added 8 points' END AS host FROM u""")
def url_hints(spark, d):
    """What words and hosts in a picture's URL add, against the same picture without them."""
    k = col("p_partkey")
    urls_ = ["https://e.example.com/x", "https://e.example.com/cover", "https://e.example.com/hero-preview-large", "https://e.example.com/og/card/media/share/social", "https://i.ytimg.com/vi/abc/maxresdefault", "https://pbs.twimg.com/media/q"]
    own, plain = (F.get(assets.scored(F.array(assets.asset(u, "image", "html"))), 0) for u in (F.get(F.array(*map(F.lit, urls_)), (k % 6).cast("int")), F.lit("https://e.example.com/x")))
    said = lambda part: F.get(F.filter("own.reasons", lambda r: F.contains(r, F.lit(part))), F.lit(0))
    found = read(spark, d, "part").select("p_partkey", own.alias("own"), plain.alias("plain"))
    return found.select("p_partkey", (col("own.score") - col("plain.score")).cast("int").alias("hints"), said("preview hints").alias("reason"), F.coalesce(said("platform thumbnail"), said("media host")).alias("host"))


# ---- whole records -----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Card ' || p_partkey WHEN 2 THEN 'Linked ' || p_partkey ELSE 'Plain ' || p_partkey END AS title, CASE p_partkey % 4 WHEN 0 THEN 'openGraph' WHEN 1 THEN 'twitter' WHEN 2 THEN 'embeddedData' ELSE 'html' END AS title_source,
CASE p_partkey % 4 WHEN 0 THEN 'article' WHEN 2 THEN 'article' ELSE 'website' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'openGraph,html' WHEN 1 THEN 'twitter,html' WHEN 2 THEN 'jsonLd,embeddedData,jsonScript,html' ELSE 'html' END AS sources FROM part""")
def field_precedence(spark, d):
    k = col("p_partkey")
    extra = (
        F.when(k % 4 == 0, text('<meta property="og:title" content="', col("p_name"), '">'))
        .when(k % 4 == 1, text('<meta name="twitter:title" content="Card ', k, '">'))
        .when(k % 4 == 2, text('<script type="application/ld+json">{"@type":"Article","headline":"Linked ', k, '"}</script>'))
        .otherwise("")
    )
    pages = read(spark, d, "part").select("p_partkey", F.lit("https://f.example.com/").alias("url"), text("<title>Plain ", k, "</title>", extra).alias("html"))
    return Engine().parse(pages).select("p_partkey", "title", col("sources.title").alias("title_source"), "type", F.array_join("diagnostics.sourcesUsed", ",").alias("sources"))


@query("""SELECT c_custkey, c_name AS title, CASE c_custkey % 8 WHEN 0 THEN 'playlist' WHEN 3 THEN 'image' ELSE 'social_post' END AS type, CASE c_custkey % 8 WHEN 0 THEN 'YouTube' WHEN 1 THEN 'Reddit' WHEN 2 THEN 'Pinterest' WHEN 3 THEN 'Behance' WHEN 4 THEN 'TikTok' WHEN 5 THEN 'Facebook' WHEN 6 THEN 'X' ELSE 'Instagram' END AS site_name,
CASE WHEN c_custkey % 8 = 0 THEN 'https://www.youtube.com/watch?v=v' || c_custkey ELSE 'https://canon.example.com/' || c_custkey END AS canonical, CASE WHEN c_custkey % 8 = 4 THEN 100 ELSE 95 END AS adapter_confidence FROM customer""")
def adapter_social(spark, d):
    html = text('<meta property="og:title" content="', col("c_name"), '"><meta property="og:url" content="https://canon.example.com/', col("c_custkey"), '"><meta property="og:description" content="A fine description of it."><meta property="og:image" content="https://cdn.example.com/big.jpg">')
    pages = read(spark, d, "customer").select("c_custkey", social_url().alias("url"), html.alias("html"))
    return Engine().parse(pages).select("c_custkey", "title", "type", "site_name", col("canonical_url").alias("canonical"), col("diagnostics.adapter.confidence").alias("adapter_confidence"))


@query("SELECT p_partkey, 'Plugin ' || p_partkey AS title, 'myPlugin' AS source, CASE WHEN p_partkey % 2 = 0 THEN 'https://f.example.com/b.png' ELSE 'https://f.example.com/a.png' END AS best FROM part")
def plugin_and_scorer(spark, d):
    def setup(api):
        api.add_extractor("myPlugin", lambda: adapters.result(title=F.concat(F.lit("Plugin "), F.col("in_p_partkey").cast("string"))))
        api.add_image_scorer(lambda a, i, every: F.when(F.endswith(a.url, F.lit("/b.png")) & (F.col("in_p_partkey") % 2 == 0), 30.0).otherwise(0.0))

    pages = read(spark, d, "part").select("p_partkey", F.lit("https://f.example.com/").alias("url"), F.lit('<title>t</title><img src="a.png"><img src="b.png">').alias("html"))
    return Engine([("mine", setup)]).parse(pages).select("p_partkey", "title", col("sources.title").alias("source"), col("best_image").alias("best"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 't' ELSE 'Ratio ' || (1000 // (p_partkey % 3)) END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Plugin extractor "ratio" failed: integer division or modulo by zero' END AS warning,
CASE WHEN p_partkey % 5 = 4 THEN 'Adapter "shop" failed: images can''t be 7' END AS other, CASE WHEN p_partkey % 5 = 4 OR p_partkey % 2 = 1 THEN NULL ELSE 'https://shop.example.com/' || p_partkey || '.png' END AS best, CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 2 = 0 THEN 'shop' END AS adapter FROM part""")
def page_functions(spark, d):
    """Plugins and an adapter as Python functions: one divides by zero on every third page, the other returns nonsense on every fifth."""

    def ratio(page):
        return {"title": f"Ratio {1000 // (page['p_partkey'] % 3)}"}

    def shop(page):
        return {"images": 7 if page["p_partkey"] % 5 == 4 else [f"https://shop.example.com/{page['p_partkey']}.png"]}

    def setup(api):
        api.add_page_function("ratio", ratio)
        api.add_page_adapter("shop", lambda url: F.contains(url, F.lit("//shop.")), shop)

    k = col("p_partkey")
    pages = read(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, "https://shop.example.com/").otherwise("https://other.example.com/").alias("url"), F.lit("<title>t</title>").alias("html"))
    warned = lambda part: F.get(F.filter("diagnostics.warnings", lambda w: F.contains(w, F.lit(part))), F.lit(0))
    return Engine([("mine", setup)]).parse(pages).select("p_partkey", "title", warned('"ratio"').alias("warning"), warned('"shop"').alias("other"), col("best_image").alias("best"), col("diagnostics.adapterUsed").alias("adapter"))


@query("SELECT s_suppkey, CAST(floor(18 * least(1, length(s_name) / 6.0) + 0.5) AS INT) AS title_points, 40 AS home, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 1 END AS bonus FROM supplier")
def text_quality(spark, d):
    from metaloom.functions.js import rounded

    source = F.when(col("s_suppkey") % 2 == 0, "adapter").otherwise("jsonScript")
    return read(spark, d, "supplier").select("s_suppkey", rounded(quality.text_points(col("s_name"), 18, 6, 120)).alias("title_points"), rounded(quality.text_points(F.lit(" sign  IN "), 114, 6, 120)).alias("home"), quality.source_bonus(source).alias("bonus"))


@query("""SELECT p_partkey, ['article', 'product', 'video', 'app'][p_partkey % 4 + 1] AS type, CASE p_partkey % 4 WHEN 0 THEN 'Headline ' || p_partkey END AS headline, CASE p_partkey % 4 WHEN 0 THEN 'World' END AS section, CASE p_partkey % 4 WHEN 0 THEN 'a|b|x|y' END AS tags,
CASE p_partkey % 4 WHEN 0 THEN '2024-01-02' END AS published, CASE p_partkey % 4 WHEN 0 THEN '2024-05-05' END AS modified, CASE p_partkey % 4 WHEN 0 THEN 'Ann ' || p_partkey || '|Bob' END AS authors, CASE p_partkey % 4 WHEN 0 THEN 'Paper' END AS publisher,
CASE p_partkey % 4 WHEN 1 THEN 'Thing ' || p_partkey || '|Brand|S' || p_partkey || '|9.5|EUR|InStock|NewCondition' END AS product, CASE p_partkey % 4 WHEN 1 THEN 4.5 END AS rating, CASE p_partkey % 4 WHEN 1 THEN CAST(p_partkey AS DOUBLE) END AS reviews,
CASE p_partkey % 4 WHEN 2 THEN 'Clip ' || p_partkey || '|2024-03-03|PT1M' END AS video, CASE p_partkey % 4 WHEN 3 THEN 'App ' || p_partkey || '|Games|Linux|0|USD' END AS app FROM part""")
def nested_objects(spark, d):
    """Articles, products, videos and apps: each field from where it counts first."""
    k = col("p_partkey")
    ld = lambda *parts: text('<script type="application/ld+json">', *parts, "</script>")
    article = text('<meta property="og:type" content="article"><meta property="article:published_time" content="2024-01-02"><meta property="article:tag" content="a"><meta property="article:tag" content="b"><meta property="og:title" content="Other">', ld('{"@type":"NewsArticle","headline":"Headline ', k, '","articleSection":"World","datePublished":"2020-01-01","dateModified":"2024-05-05","keywords":"x, y","author":[{"name":"Ann ', k, '"},{"name":"Bob"}],"publisher":{"name":"Paper"}}'))
    product = ld('{"@type":"Product","name":"Thing ', k, '","brand":{"name":"Brand"},"sku":"S', k, '","offers":{"price":"9.5","priceCurrency":"EUR","availability":"https://schema.org/InStock","itemCondition":"https://schema.org/NewCondition"},"aggregateRating":{"ratingValue":"4.5","reviewCount":', k, "}}")
    video = ld('{"@type":"VideoObject","name":"Clip ', k, '","uploadDate":"2024-03-03","duration":"PT1M"}')
    app = text('<meta name="application-name" content="App ', k, '">', ld('{"@type":"SoftwareApplication","name":"Other","applicationCategory":"Games","operatingSystem":"Linux","offers":[{"price":0,"priceCurrency":"USD"}]}'))
    html = F.get(F.array(article, product, video, app), (k % 4).cast("int"))
    found = Engine().parse(read(spark, d, "part").select("p_partkey", F.lit("https://f.example.com/").alias("url"), html.alias("html")))
    of = lambda kind: col("type") == kind
    joined = lambda kind, *fields: F.when(of(kind), F.concat_ws("|", *fields))
    a = lambda f: F.when(of("article"), col(f"article.{f}"))
    return found.select(
        "p_partkey", "type", a("headline").alias("headline"), a("section").alias("section"), joined("article", "article.tags").alias("tags"), a("publishedTime").alias("published"), a("modifiedTime").alias("modified"),
        F.when(of("article"), F.array_join(F.transform("article.authors", lambda x: x["name"]), "|")).alias("authors"), a("publisher.name").alias("publisher"),
        joined("product", *[f"product.{f}" for f in ("name", "brand.name", "sku", "price", "currency", "availability", "condition")]).alias("product"), col("product.ratingValue").alias("rating"), col("product.reviewCount").alias("reviews"),
        joined("video", *[f"video.{f}" for f in ("title", "publishedTime", "duration")]).alias("video"), joined("app", *[f"app.{f}" for f in ("name", "category", "operatingSystem", "price", "currency")]).alias("app"),
    )


@query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'article' WHEN 1 THEN 'product' WHEN 2 THEN 'video' WHEN 3 THEN 'profile' WHEN 4 THEN 'app' WHEN 5 THEN 'audio' ELSE 'website' END AS type FROM part""")
def infer_type(spark, d):
    k = col("p_partkey")
    node = lambda kind: f'<script type="application/ld+json">{{"@type":"{kind}","name":"n"}}</script>'
    shapes = ['<meta property="og:type" content="article">', '<meta property="og:type" content="product.item">', node("VideoObject"), node("Person"), node("MobileApplication"), node("AudioObject"), ""]
    html = text("<title>t", k, "</title>", F.get(F.array(*map(F.lit, shapes)), (k % 7).cast("int")))
    pages = read(spark, d, "part").select("p_partkey", F.lit("https://f.example.com/").alias("url"), html.alias("html"))
    return Engine().parse(pages).select("p_partkey", "type")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'https://o.example.com/p' || n_nationkey || '.jpg' END AS image, CASE WHEN n_nationkey % 3 = 0 THEN 640.0 END AS width, CASE n_nationkey % 3 WHEN 1 THEN 'Could not fetch oEmbed endpoint https://o.example.com/' || n_nationkey || ': no response'
WHEN 2 THEN 'Could not fetch oEmbed endpoint https://o.example.com/' || n_nationkey || ': the response is not JSON' END AS warning FROM nation""")
def oembed_documents(spark, d):
    k = col("n_nationkey")
    n = read(spark, d, "nation")
    pages = n.select("n_nationkey", F.lit("https://o.example.com/").alias("url"), text('<link rel="alternate" type="application/json+oembed" href="/', k, '">').alias("html"))
    body = F.when(k % 3 == 0, text('{"type":"photo","url":"https://o.example.com/p', k, '.jpg","width":640,"height":480}')).otherwise("<html>")
    docs = n.where(k % 3 != 1).select(text("https://o.example.com/", k).alias("href"), body.alias("body"))
    first = F.get("images", F.lit(0))
    return Engine().parse(pages, docs).select("n_nationkey", first.url.alias("image"), first.width.alias("width"), F.get("diagnostics.warnings", F.lit(0)).alias("warning"))


# ---- fetching ----------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS k, n_nationkey + 1 AS nxt FROM nation WHERE n_nationkey % 8 <> 7), w AS (SELECT n_nationkey AS start, n_nationkey AS pos, 0 AS hops FROM nation UNION ALL SELECT start, nxt, hops + 1 FROM w JOIN e ON pos = k WHERE hops < 6),
l AS (SELECT start, max(hops) AS hops, max(pos) AS pos FROM w GROUP BY 1) SELECT start, CASE WHEN hops <= 5 AND n_nationkey IS NOT NULL THEN 'https://n.example.com/' || pos END AS final_url, CASE WHEN hops <= 5 AND n_nationkey IS NOT NULL THEN hops END AS hops, CASE WHEN hops > 5 THEN 'Too many redirects. Maximum allowed redirects: 5.' WHEN n_nationkey IS NULL THEN 'No response for https://n.example.com/' || pos END AS error FROM l LEFT JOIN nation ON n_nationkey = pos""")
def redirect_chain(spark, d):
    n = read(spark, d, "nation")
    k = col("n_nationkey")
    moved = k % 8 != 7
    responses = n.select(text("https://n.example.com/", k).alias("request_url"), F.when(moved, 302).otherwise(200).alias("status"), F.when(moved, text("/", k + 1)).alias("location"), F.lit("text/html").alias("content_type"), F.lit("").alias("body"))
    found = fetch.follow(n.select(k.alias("start"), text("https://n.example.com/", k).alias("url")), responses)
    return found.select("start", "final_url", F.when(col("error").isNull(), F.size("redirects")).alias("hops"), "error")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey AS k, c_custkey % 10 AS kind, CASE WHEN c_custkey % 10 < 6 THEN (c_custkey * 3) % n + 1 END AS nxt FROM customer, n),
w AS (SELECT k AS start, k AS pos, 0 AS hops FROM e UNION ALL SELECT start, nxt, hops + 1 FROM w JOIN e ON pos = k WHERE nxt IS NOT NULL AND hops < 5), l AS (SELECT start, max(hops) AS hops, arg_max(pos, hops) AS pos FROM w GROUP BY start),
r AS (SELECT start, hops, 'https://n.example.com/' || pos AS place, CASE WHEN nxt IS NOT NULL THEN 'Too many redirects. Maximum allowed redirects: 5.' WHEN kind = 6 THEN 'Redirect response from https://n.example.com/' || pos || ' did not include a Location header.' WHEN kind = 7 THEN 'No response for https://n.example.com/' || pos END AS error, kind FROM l JOIN e ON pos = k)
SELECT o_orderkey, hops, CASE WHEN error IS NULL THEN place END AS final_url, CASE WHEN error IS NULL THEN CASE kind WHEN 8 THEN 404 ELSE 200 END END AS status, CASE WHEN error IS NULL THEN 'body of ' || place END AS body, error FROM orders JOIN r ON o_custkey = start""")
def redirect_frontier(spark, d):
    """Every order asks for its customer's URL; customers redirect to each other, in cycles too, and end in pages, errors and nothing."""
    customers = read(spark, d, "customer")
    k, n = col("c_custkey"), customers.count()
    at, kind = text("https://n.example.com/", k), k % 10
    status = F.when(kind < 7, 302).when(kind == 8, 404).otherwise(200)
    answers = customers.where(kind != 7).select(at.alias("request_url"), status.alias("status"), F.when(kind < 6, text("/", k * 3 % n + 1)).alias("location"), F.lit("text/html").alias("content_type"), text("body of ", at).alias("body"))
    asked = read(spark, d, "orders").select("o_orderkey", text("https://n.example.com/", col("o_custkey")).alias("url"))
    found = fetch.follow(asked, answers)
    return found.select("o_orderkey", F.size("redirects").alias("hops"), "final_url", "status", "body", "error")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Localhost URLs are blocked by default.' WHEN 1 THEN 'Loopback address is blocked: 127.0.0.1' WHEN 2 THEN 'Private or reserved network address is blocked: 10.0.0.' || n_nationkey WHEN 3 THEN 'Unsupported URL protocol' END AS blocked FROM nation""")
def ssrf_block(spark, d):
    k = col("n_nationkey")
    url = F.when(k % 5 == 0, text("http://app.localhost:8080/", k)).when(k % 5 == 1, "http://127.0.0.1/x").when(k % 5 == 2, text("https://in", k, ".example.com/")).when(k % 5 == 3, "file:///etc/passwd").otherwise(text("https://out", k, ".example.com/"))
    n = read(spark, d, "nation")
    dns = n.select(F.explode(F.array(F.struct(text("in", k, ".example.com").alias("host"), text("10.0.0.", k).alias("address")), F.struct(text("out", k, ".example.com").alias("host"), F.lit("93.184.216.34").alias("address")))).alias("r")).select("r.*")
    return fetch.guarded(n.select("n_nationkey", url.alias("url")), dns).select("n_nationkey", "blocked")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), r AS (SELECT user_id, ts, event_id AS answer, value FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, answer, r.value FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts >= r.ts""")
def last_before(spark, d):
    """Each event with its user's last purchase until then."""
    events = read(spark, d, "events")
    purchase = col("event_type") == "purchase"
    answers = events.where(purchase).select("user_id", "ts", col("event_id").alias("answer"), "value")
    found = joins.as_of(events.where(~purchase).select("event_id", "user_id", col("ts").alias("at")), answers, ["user_id"], "at", "ts")
    return found.select("event_id", "user_id", "last.answer", "last.value")


@query("""WITH b AS (SELECT s_suppkey, (s_suppkey * 40503) % 65536 * 65536 AS lo, (s_suppkey * 40503) % 65536 * 65536 + CASE s_suppkey % 4 WHEN 0 THEN 65535 WHEN 1 THEN 16383 WHEN 2 THEN 5000 ELSE 0 END AS hi FROM supplier),
a AS (SELECT o_orderkey, (o_custkey * 40503) % 65536 * 65536 + (o_orderkey % 3) * 4001 AS n FROM orders) SELECT o_orderkey, s_suppkey FROM a JOIN b ON n BETWEEN lo AND hi""")
def address_blocks(spark, d):
    """Addresses of orders in blocks of suppliers: prefixes, single addresses and ranges that are none."""
    dotted = lambda n: text((F.shiftright(n, 24)), ".", F.shiftright(n, 16).bitwiseAND(255), ".", F.shiftright(n, 8).bitwiseAND(255), ".", n.bitwiseAND(255))
    low = lambda k: k * 40503 % 65536 * 65536
    k = col("s_suppkey")
    block = F.when(k % 4 == 0, text(dotted(low(k)), "/16")).when(k % 4 == 1, text(dotted(low(k)), "/18")).when(k % 4 == 2, text(dotted(low(k)), "-", dotted(low(k) + 5000))).otherwise(dotted(low(k)))
    orders = read(spark, d, "orders").select("o_orderkey", dotted(low(col("o_custkey")) + col("o_orderkey") % 3 * 4001).alias("address"))
    return joins.in_blocks(orders, read(spark, d, "supplier").select("s_suppkey", block.alias("block"))).select("o_orderkey", "matched.s_suppkey")


@query("""WITH h AS (SELECT o_orderkey, 'h' || o_custkey % 10 || '.s' || o_custkey % 7 || '.d' || o_custkey % 200 || '.example' || o_custkey % 5 || '.com' AS host FROM orders),
l AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'd' || s_suppkey || '.example' || s_suppkey % 5 || '.com' WHEN 1 THEN 's' || s_suppkey % 7 || '.d' || s_suppkey || '.example' || s_suppkey % 5 || '.com' WHEN 2 THEN 'example' || s_suppkey % 4 || '.com' ELSE 'ample' || s_suppkey % 5 || '.com' END AS domain FROM supplier)
SELECT o_orderkey, arg_max(domain, length(domain)) AS listed FROM h LEFT JOIN l ON host = domain OR host LIKE '%.' || domain GROUP BY o_orderkey""")
def listed_domains(spark, d):
    """The longest domain of suppliers that the host of an order is below."""
    k, c = col("s_suppkey"), col("o_custkey")
    listed = F.when(k % 4 == 0, text("d", k, ".example", k % 5, ".com")).when(k % 4 == 1, text("s", k % 7, ".d", k, ".example", k % 5, ".com")).when(k % 4 == 2, text("example", k % 4, ".com")).otherwise(text("ample", k % 5, ".com"))
    hosts = read(spark, d, "orders").select("o_orderkey", text("h", c % 10, ".s", c % 7, ".d", c % 200, ".example", c % 5, ".com").alias("host"))
    return joins.listed_domains(hosts, read(spark, d, "supplier").select(listed.alias("domain"))).select("o_orderkey", "listed")


_SESSIONS = """WITH e AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(event_id) AS BIGINT) AS ids, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us FROM s GROUP BY user_id, session"""


def _timed_events(spark, d):
    return read(spark, d, "events").withColumn("ts", col("ts").cast("timestamp"))


def _micros(c):
    return F.unix_micros(col(c))


def _session_rows(found):
    return found.select("user_id", "n", "cents", "ids", (_micros("last") - _micros("first")).alias("span_us"))


def _sessions_of(events):
    return activity.sessions(events, "user_id", "ts", "2 hours", "10 minutes", cents=F.round(col("value") * 100).cast("bigint"), ids=col("event_id"))


@query(_SESSIONS)
def event_sessions(spark, d):
    """Sessions of users, from the table."""
    return _session_rows(_sessions_of(_timed_events(spark, d)))


@query(_SESSIONS)
def streamed_sessions(spark, d):
    """The same from a stream of the events in four micro-batches; one late row of nobody closes what is open."""
    events = _timed_events(spark, d)
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select("ts", F.lit(-1).cast("bigint").alias("user_id"))
    found, _ = activity.drained(_sessions_of(activity.replayed(events.unionByName(end, allowMissingColumns=True), "ts", 4)))
    return _session_rows(found.where("user_id >= 0"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS changed FROM events)
SELECT 'https://e.example.com/' || user_id AS url, count(*) AS times, CAST(sum(changed) AS BIGINT) AS changes, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us FROM e GROUP BY user_id""")
def streamed_last_seen(spark, d):
    """What a stateful stream has seen of each URL by its end."""
    pages = _timed_events(spark, d).select(text("https://e.example.com/", col("user_id")).alias("url"), "ts", col("event_type").alias("html"))
    found, _ = activity.drained(activity.last_seen(activity.replayed(pages, "ts", 4), "ts", "html"), rocks=True)
    last = found.groupBy("url").agg(F.max_by(F.struct("first", "last", "times", "changes"), "times").alias("x"))
    return last.select("url", "x.times", "x.changes", (_micros("x.last") - _micros("x.first")).alias("span_us"))


@query("""SELECT l.event_id AS page_id, r.event_id AS document FROM events l LEFT JOIN events r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 3 HOUR WHERE l.event_type = 'click'""")
def streamed_documents(spark, d):
    """Clicks with the purchases of their user within three hours, from two streams; those without one come when their time is over."""
    events = _timed_events(spark, d)
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    links = events.where("event_type = 'click'").select(col("event_id").alias("page_id"), col("user_id").cast("string").alias("href"), col("ts").alias("asked"))
    documents = events.where("event_type = 'purchase'").select(col("user_id").cast("string").alias("doc_href"), col("event_id").alias("document"), col("ts").alias("got"))
    links, documents = links.unionByName(end.select(col("ts").alias("asked")), allowMissingColumns=True), documents.unionByName(end.select(col("ts").alias("got")), allowMissingColumns=True)
    found, _ = activity.drained(activity.documents_of_pages(activity.replayed(links, "asked", 3), activity.replayed(documents, "got", 3), "3 HOURS"))
    return found.where("page_id IS NOT NULL").select("page_id", "document")


@query("""SELECT 'https://u.example.com/' || user_id AS url, 'body of ' || max(event_id) AS html, 1 AS entries FROM events GROUP BY user_id""")
def cache_upsert(spark, d):
    """Events as answers for their users' URLs, put into a cache in three parts, one of them twice; the newest answer of each URL stays."""
    events = _timed_events(spark, d)
    answers = events.select(text("https://u.example.com/", col("user_id")).alias("url"), text("body of ", col("event_id")).alias("html"), F.lit(200).alias("status"), F.timestamp_seconds(col("event_id")).alias("fetched_at"), (col("event_id") % 3).alias("part"))
    cache = PageCache(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", buckets=16)
    for part in (2, 0, 1, 2):
        cache.put(answers.where(col("part") == part).drop("part"))
    return cache.rows().groupBy("url").agg(F.max("html").alias("html"), F.count(F.lit(1)).cast("int").alias("entries"))


@query("""SELECT event_type, part, CAST(GROUPING(event_type) * 2 + GROUPING(part) AS INTEGER) AS level, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS close FROM (SELECT *, 'p' || event_id % 7 AS part FROM events) GROUP BY CUBE (event_type, part)""")
def event_cube(spark, d):
    """Events by type and part and all of their combinations; users are counted by sketches of two halves, added up, and exactly beside them."""
    events = read(spark, d, "events").select("event_id", "event_type", "user_id", text("p", col("event_id") % 7).alias("part"))
    halves = [reports.counted(events.where(col("event_id") % 2 == k), ["event_type", "part"], "user_id") for k in (0, 1)]
    found = reports.cube(reports.added(halves[0].unionByName(halves[1]), ["event_type", "part"]), ["event_type", "part"])
    exact = events.cube("event_type", "part").agg(F.grouping_id().cast("int").alias("_level"), F.count_distinct("user_id").alias("users")).select(col("event_type").alias("_type"), col("part").alias("_part"), "_level", "users")
    same = col("event_type").eqNullSafe(col("_type")) & col("part").eqNullSafe(col("_part")) & (col("level") == col("_level"))
    return found.join(exact, same).select("event_type", "part", "level", "n", "users", (F.abs(col("about") - col("users")) <= 0.07 * col("users") + 1).alias("close"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN 82 WHEN 3 THEN NULL ELSE 70 END AS confidence, CASE n_nationkey % 4 WHEN 0 THEN 60 WHEN 3 THEN NULL ELSE 35 END AS completeness, CASE n_nationkey % 4 WHEN 0 THEN 300.0 + n_nationkey END AS width FROM nation""")
def direct_media(spark, d):
    k = col("n_nationkey")
    url = F.when(k % 4 == 0, text("https://c.example.com/a?width=", k + 300, "&height=20")).when(k % 4 == 1, "https://c.example.com/v.MP4?x").when(k % 4 == 2, "https://c.example.com/s").otherwise("https://c.example.com/page")
    kind = F.when(k % 4 == 0, "image/png").when(k % 4 == 2, "audio/mpeg").otherwise("text/html")
    m = fetch.direct_media(url, kind, F.lit(None).cast("binary"))
    return read(spark, d, "nation").select("n_nationkey", m.alias("m")).select("n_nationkey", "m.kind", "m.confidence", "m.completeness", "m.width")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'provider_verification_required' WHEN 1 THEN 'provider_blocked_request' WHEN 2 THEN 'provider_blocked_request' WHEN 3 THEN 'provider_blocked_request' END AS reason FROM nation""")
def block_reason(spark, d):
    k = col("n_nationkey")
    html = F.when(k % 5 == 0, "<title>Reddit - Please wait for verification</title>").when(k % 5 == 1, "<p>Whoa there,\n pardner!</p>").when(k % 5 == 2, "<title>Blocked</title>").otherwise(text("<p>fine ", col("n_name"), "</p>"))
    return read(spark, d, "nation").select("n_nationkey", fetch.block_reason(F.when(k % 5 == 3, 429).otherwise(200), html).alias("reason"))


@query("SELECT p_partkey, p_size * 60 AS width, p_size * 20 + 200 AS height FROM part")
def image_dimensions(spark, d):
    number = lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(col("p_size") * 60), number(col("p_size") * 20 + 200)))
    size = image_files.dimensions(header, F.lit("image/png"))
    return read(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 1000 ELSE 60000 END AS BIGINT) AS ms FROM nation")
def retry_after(spark, d):
    value = F.when(col("n_nationkey") % 2 == 0, col("n_nationkey").cast("string")).otherwise("Thu, 01 Jan 2026 00:01:00 GMT")
    return read(spark, d, "nation").select("n_nationkey", fetch.retry_after_ms(value, F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("ms"))


@query("""SELECT n_nationkey, TRUE AS ok, n_name AS title, 'social_post' AS type, 'https://i.redd.it/' || n_nationkey || '.jpg' AS best_image, 'u' || n_nationkey AS author, 'reddit:jsonEndpoint' AS method FROM nation""")
def reddit_json_post(spark, d):
    """Posts of a listing, as records."""
    k = col("n_nationkey")
    body = text('[{"data":{"children":[{"kind":"t3","data":{"id":"p', k, '","title":"', col("n_name"), '","author":"u', k, '","permalink":"/r/s/comments/p', k, '/","url_overridden_by_dest":"https://i.redd.it/', k, '.jpg","created_utc":1767225600}}]}}]')
    n = read(spark, d, "nation").select("n_nationkey", text("https://www.reddit.com/r/s/comments/p", k, "/t").alias("url"), body.alias("body"))
    responses = n.select(text("https://www.reddit.com/r/s/comments/p", k, "/t.json").alias("request_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("application/json").alias("content_type"), "body")
    return fetch.records(n.select("n_nationkey", "url"), responses).select("n_nationkey", "ok", "title", "type", "best_image", col("author.name").alias("author"), "method")


@query("""SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'Json ' || c_custkey WHEN 1 THEN 'Old ' || c_custkey WHEN 2 THEN 'Page ' || c_custkey END AS title,
CASE c_custkey % 4 WHEN 0 THEN 'reddit:jsonEndpoint' WHEN 1 THEN 'reddit:oldReddit' WHEN 2 THEN 'reddit:htmlFallback' ELSE 'reddit:blockedProvider' END AS method,
CASE c_custkey % 4 WHEN 0 THEN '200,,' WHEN 1 THEN '429,200,' WHEN 2 THEN '200,403,200' ELSE '429,200,403' END AS statuses, CASE WHEN c_custkey % 4 = 3 THEN 'provider_verification_required' END AS reason,
CASE c_custkey % 4 WHEN 1 THEN 'reddit:jsonEndpoint returned 429' WHEN 2 THEN 'reddit:oldReddit returned 403' WHEN 3 THEN 'reddit:jsonEndpoint returned 429; reddit:oldReddit returned 200; reddit:htmlFallback returned 403' END AS said,
CASE c_custkey % 4 WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE END AS again, CAST(CASE WHEN c_custkey % 4 = 3 THEN c_custkey * 1000 END AS BIGINT) AS wait_ms FROM customer""")
def reddit_fallbacks(spark, d):
    """Posts whose listing answers, is refused or isn't one; the old site and the page stand in, and what is refused everywhere says when to try again."""
    k = col("c_custkey")
    post = text("/r/s/comments/p", k, "/t")
    listing = text('[{"data":{"children":[{"kind":"t3","data":{"id":"p', k, '","title":"Json ', k, '","permalink":"/r/s/comments/p', k, '/t/"}}]}}]')
    page = lambda name: text('<title>x</title><meta property="og:title" content="', name, " ", k, '">')
    refused, verify = F.lit("<p>no</p>"), F.lit("<title>Reddit - Please wait for verification</title>")
    answer = lambda at, status, body, after=None: F.struct(F.concat(F.lit(f"https://{at}"), post, F.lit(".json" if body is listing or status == 429 or body is odd else "")).alias("request_url"), F.lit(status).alias("status"), body.alias("body"), (after if after is not None else F.lit(None).cast("string")).alias("retry_after"))
    odd = F.lit('{"kind":"other"}')
    www, old = "www.reddit.com", "old.reddit.com"
    given = [
        F.array(answer(www, 200, listing)), F.array(answer(www, 429, refused), answer(old, 200, page("Old"))),
        F.array(answer(www, 200, odd), answer(old, 403, refused), answer(www, 200, page("Page"))), F.array(answer(www, 429, refused, k.cast("string")), answer(old, 200, verify), answer(www, 403, refused)),
    ]
    customers = read(spark, d, "customer")
    responses = customers.select(F.explode(F.get(F.array(*given), (k % 4).cast("int"))).alias("r")).select("r.*", F.lit(None).cast("string").alias("location"), F.lit("text/html").alias("content_type"))
    r = fetch.records(customers.select("c_custkey", F.concat(F.lit("https://www.reddit.com"), post).alias("url")), responses)
    statuses = F.array_join(F.transform("attempts", lambda a: a.status.cast("string")), ",", "")
    return r.select("c_custkey", "ok", "title", "method", statuses.alias("statuses"), col("provider.reason").alias("reason"), col("retry.reason").alias("said"), col("retry.retryable").alias("again"), col("retry.retryAfterMs").alias("wait_ms"))


# ---- every site's adapter on pages of its own --------------------------------------------------------------------------


def by_turn(*choices: Column) -> Column:
    """The choice whose turn it is by the customer's key."""
    return F.get(F.array(*choices), (col("c_custkey") % len(choices)).cast("int"))


def script(*parts) -> Column:
    return text('<script type="application/json">', *parts, "</script>")


def site_records(spark, d, pages: list[tuple[Column, Column]]) -> DataFrame:
    """Records of the customers' pages, each of the (URL, HTML) pairs in turn."""
    made = read(spark, d, "customer").select("c_custkey", by_turn(*[u for u, _ in pages]).alias("url"), by_turn(*[h for _, h in pages]).alias("html"))
    return Engine().parse(made)


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Played ' WHEN 1 THEN 'List ' WHEN 2 THEN 'Post ' WHEN 3 THEN 'Html ' ELSE 'Linked ' END || c_custkey AS title, CASE c_custkey % 5 WHEN 1 THEN 'playlist' WHEN 2 THEN 'social_post' ELSE 'video' END AS type,
CASE c_custkey % 5 WHEN 1 THEN NULL WHEN 2 THEN 'https://www.youtube.com/post/P' || c_custkey ELSE 'https://www.youtube.com/watch?v=v' || c_custkey END AS canonical,
CASE c_custkey % 5 WHEN 0 THEN 'youtube:ytInitialPlayerResponse' WHEN 1 THEN 'youtube:ytInitialData' WHEN 2 THEN 'youtube:openGraph' WHEN 3 THEN 'youtube:html' ELSE 'youtube:structuredData.VideoObject' END AS method,
CASE WHEN c_custkey % 5 = 1 THEN 'a' || c_custkey || '=One,b' || c_custkey || '=Two' END AS videos FROM customer""")
def adapter_youtube(spark, d):
    k = col("c_custkey")
    item = lambda id_, title: text('{"playlistVideoRenderer":{"videoId":"', id_, k, '","title":{"simpleText":"', title, '"}}}')
    listed = text('<script>var ytInitialData = {"contents":[', item("a", "One"), ",", item("b", "Two"), ",", item("a", "Again"), '],"header":{"playlistHeaderRenderer":{"title":{"simpleText":"List ', k, '"}}}};</script>')
    pages = [
        (text("https://www.youtube.com/watch?v=v", k), text('<title>Other - YouTube</title><script>var ytInitialPlayerResponse = {"videoDetails":{"title":"Played ', k, '","shortDescription":"Text"}};</script>')),
        (text("https://www.youtube.com/playlist?list=L", k), listed),
        (text("https://www.youtube.com/post/P", k), text('<meta property="og:title" content="Post ', k, '"><meta property="og:url" content="https://www.youtube.com/post/P', k, '">')),
        (text("https://youtu.be/v", k), text("<title>Html ", k, " - YouTube</title>")),
        (text("https://m.youtube.com/shorts/v", k), text('<meta property="og:title" content="Later"><script type="application/ld+json">{"@type":"VideoObject","name":"Linked ', k, '"}</script>')),
    ]
    videos = F.array_join(F.transform("playlist.videos", lambda v: F.concat(v.id, F.lit("="), v.title)), ",")
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("canonical_url").alias("canonical"), col("diagnostics.extractionMethod").alias("method"), videos.alias("videos"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Said ' WHEN 1 THEN 'Linked ' WHEN 2 THEN 'Mine ' WHEN 3 THEN 'Card ' ELSE 'Plain ' END || c_custkey AS title, CASE WHEN c_custkey % 5 IN (2, 3) THEN 'website' ELSE 'social_post' END AS type,
CASE c_custkey % 5 WHEN 1 THEN 'w' || c_custkey WHEN 2 THEN 'u' || c_custkey END AS author,
CASE c_custkey % 5 WHEN 0 THEN 'reddit:embeddedStructuredData' WHEN 1 THEN 'reddit:structuredData' WHEN 2 THEN 'reddit:openGraph' WHEN 3 THEN 'reddit:twitter' ELSE 'reddit:html' END AS method FROM customer""")
def adapter_reddit(spark, d):
    k = col("c_custkey")
    pages = [
        (text("https://www.reddit.com/r/s/comments/p", k, "/t"), F.concat(F.lit("<title>Other</title>"), script('{"postTitle":"Said ', k, '"}'))),
        (text("https://redd.it/q", k), text('<script type="application/ld+json">{"@type":"DiscussionForumPosting","name":"Linked ', k, '","author":{"name":"w', k, '"}}</script>')),
        (text("https://www.reddit.com/user/u", k), text('<meta property="og:title" content="Mine ', k, ' : r/abc">')),
        (text("https://old.reddit.com/r/s", k), text('<meta name="twitter:title" content="Card ', k, '">')),
        (text("https://www.reddit.com/r/s/comments/r", k), text("<title>Plain ", k, " : r/s</title>")),
    ]
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("author.name").alias("author"), col("diagnostics.extractionMethod").alias("method"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'A long title of pin ' WHEN 1 THEN 'Grid title of pin ' ELSE 'Board ' END || c_custkey AS title, CASE WHEN c_custkey % 3 = 2 THEN 'image' ELSE 'social_post' END AS type, CASE WHEN c_custkey % 3 = 1 THEN 'u' || c_custkey END AS author, 'Pinterest' AS site_name FROM customer""")
def adapter_pinterest(spark, d):
    """The best text counts, wherever it stands: the long title in markup beats the short one of Open Graph."""
    k = col("c_custkey")
    pages = [
        (text("https://www.pinterest.com/pin/", k, "/"), text('<meta property="og:title" content="Pin"><title>A long title of pin ', k, "</title>")),
        (text("https://pin.it/", k), script('{"gridTitle":"Grid title of pin ', k, '","pinner":{"username":"u', k, '"}}')),
        (text("https://www.pinterest.com/me/board", k), text("<title>Board ", k, "</title>")),
    ]
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("author.name").alias("author"), "site_name")


@query("""SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'Project number ' ELSE 'Portfolio of ' END || c_custkey AS title, CASE c_custkey % 2 WHEN 0 THEN 'image' ELSE 'website' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'o' || c_custkey END AS author, 'Behance' AS site_name FROM customer""")
def adapter_behance(spark, d):
    k = col("c_custkey")
    pages = [
        (text("https://www.behance.net/gallery/", k, "/x"), script('{"projectTitle":"Project number ', k, '","owners":[{"username":"o', k, '"}]}')),
        (text("https://www.behance.net/u", k), text("<title>Portfolio of ", k, "</title>")),
    ]
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("author.name").alias("author"), "site_name")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A caption of ' || c_custkey WHEN 1 THEN 'Tune ' || c_custkey || ' - Band' WHEN 2 THEN 'TikTok post by @me' ELSE 'A clip of number ' || c_custkey END AS title, 'social_post' AS type, CASE c_custkey % 4 WHEN 0 THEN 'Nick' ELSE 'me' END AS author,
CASE c_custkey % 4 WHEN 0 THEN 'tiktok:itemStruct.desc' WHEN 1 THEN 'tiktok:itemStruct.music' WHEN 2 THEN 'tiktok:urlFallback' ELSE 'tiktok:fallback' END AS method, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS plays,
CASE WHEN c_custkey % 4 = 0 THEN '2026-01-01T00:00:00.000Z' END AS published, CASE WHEN c_custkey % 4 = 0 THEN 'https://p16.tiktokcdn.com/' || c_custkey || '.jpg' END AS image FROM customer""")
def adapter_tiktok(spark, d):
    """The item of the video's own id counts, not its neighbours."""
    k = col("c_custkey")
    url = text("https://www.tiktok.com/@me/video/", k)
    item = lambda *parts: text('<script id="__UNIVERSAL_DATA_FOR_REHYDRATION__" type="application/json">{"__DEFAULT_SCOPE__":{"webapp.video-detail":{"itemInfo":{"itemStruct":', *parts, "}}}}</script>")
    pages = [
        (url, item('{"id":"', k, '","desc":" A caption of ', k, ' ","createTime":"1767225600","author":{"nickname":"Nick"},"stats":{"playCount":', k, '},"video":{"cover":"https://p16.tiktokcdn.com/', k, '.jpg"}}')),
        (url, item('{"id":"', k, '","music":{"title":"Tune ', k, '","authorName":"Band"}}')),
        (url, text('<meta property="og:title" content="TikTok - Make Your Day">')),
        (url, text('<meta property="og:title" content="A clip of number ', k, '">')),
    ]
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("author.name").alias("author"), col("diagnostics.extractionMethod").alias("method"), col("video.viewCount").alias("plays"), col("publish_date").alias("published"), col("best_image").alias("image"))


@query("""SELECT c_custkey, 'Title ' || c_custkey AS title, CASE c_custkey % 5 WHEN 0 THEN 'image' WHEN 3 THEN 'website' ELSE 'social_post' END AS type, 'Facebook' AS site_name, CASE WHEN c_custkey % 5 = 4 THEN 'https://cdn.example.com/big.jpg' END AS image FROM customer""")
def adapter_facebook(spark, d):
    """Pages without the path of a post are posts if they have media."""
    k = col("c_custkey")
    title = text('<meta property="og:title" content="Title ', k, '">')
    paths = [("photo.php?fbid=", title), ("page/posts/", title), ("permalink.php?id=1&story_fbid=", title), ("page", title), ("page", F.concat(title, F.lit('<meta property="og:image" content="https://cdn.example.com/big.jpg">')))]
    return site_records(spark, d, [(text("https://www.facebook.com/", p, k), h) for p, h in paths]).select("c_custkey", "title", "type", "site_name", col("best_image").alias("image"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'The whole text of ' ELSE 'Title ' END || c_custkey AS title, CASE WHEN c_custkey % 3 = 2 THEN 'profile' ELSE 'social_post' END AS type, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey END AS author, 'X' AS site_name FROM customer""")
def adapter_twitter(spark, d):
    k = col("c_custkey")
    title = text('<meta property="og:title" content="Title ', k, '">')
    pages = [(text("https://x.com/u/status/", k), script('{"full_text":"The whole text of ', k, '","screen_name":"s', k, '"}')), (text("https://t.co/", k), title), (text("https://twitter.com/u", k), title)]
    return site_records(spark, d, pages).select("c_custkey", "title", "type", col("author.name").alias("author"), "site_name")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A caption of picture ' ELSE 'Title ' END || c_custkey AS title, CASE WHEN c_custkey % 4 = 3 THEN 'profile' ELSE 'social_post' END AS type, CASE WHEN c_custkey % 4 = 0 THEN 'o' || c_custkey END AS author, 'Instagram' AS site_name FROM customer""")
def adapter_instagram(spark, d):
    k = col("c_custkey")
    title = text('<meta property="og:title" content="Title ', k, '">')
    stated = script('{"caption":"A caption of picture ', k, '","owner":{"username":"o', k, '"}}')
    return site_records(spark, d, [(text("https://www.instagram.com/", p, k), h) for p, h in (("p/", stated), ("reel/", title), ("tv/", title), ("u", title))]).select("c_custkey", "title", "type", col("author.name").alias("author"), "site_name")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'playlistId=L,videoId=v' || c_custkey WHEN 1 THEN 'postId=p' || c_custkey || ',subreddit=sub' WHEN 2 THEN 'pinId=' || c_custkey WHEN 3 THEN 'projectId=' || c_custkey
WHEN 4 THEN 'postId=' || c_custkey || ',username=user' WHEN 5 THEN 'postId=' || c_custkey WHEN 6 THEN 'statusId=' || c_custkey ELSE 'shortcode=' || c_custkey END AS ids FROM customer""")
def site_ids(spark, d):
    pages = read(spark, d, "customer").select(col("c_custkey").alias("in_c_custkey"), social_url().alias("url"), F.lit("<title>t</title>").alias("html"))
    found = F.get("adapter_results", F.lit(0)).identifiers
    told = F.array_join(F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e.key, F.lit("="), e.value))), ",")
    return with_media(with_tags(scan(pages)), adapters.DEFAULT, []).select(col("in_c_custkey").alias("c_custkey"), told.alias("ids"))


_GIVEN = "CASE WHEN p_partkey % 2 = 0 THEN {} ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN {} ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN {} ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN {} ELSE 0 END"


@query(f"SELECT p_partkey, least(100, 45 + {_GIVEN.format(22, 14, 14, 6)}) AS own, least(100, 55 + {_GIVEN.format(15, 10, 15, 5)}) AS told FROM part")
def adapter_confidence(spark, d):
    k = col("p_partkey")
    given = [F.when(k % 2 == 0, "t"), F.when(k % 3 == 0, "d"), k % 5 == 0, F.when(k % 7 == 0, "a")]
    return read(spark, d, "part").select("p_partkey", quality.adapter_confidence(*given).alias("own"), quality.adapter_confidence(*given, *quality.DIAGNOSTIC).alias("told"))


@query("""SELECT p_partkey, 'https://i.example.com/' || f AS url, CAST(w AS DOUBLE) AS width FROM part, LATERAL (VALUES ('keep' || p_partkey || '.jpg', NULL), ('sprites.png', NULL), ('bigicon.png', 65), ('photo.png', 64)) v(f, w)
UNION ALL SELECT p_partkey, 'https://i.example.com/wide' || p_partkey || '.jpg', p_size FROM part WHERE p_size > 2 UNION ALL SELECT p_partkey, 'https://i.example.com/logo' || p_partkey || '.png', p_size + 40 FROM part WHERE p_size + 40 > 64""")
def image_filters(spark, d):
    """Pictures that are no URL of a file, tracking pixels, what is at most two pixels wide or high, and small icons are dropped."""
    k, size = col("p_partkey"), col("p_size")
    html = text(
        '<img src="/keep', k, '.jpg"><img src="data:image/png;base64,x"><img src="blob:x"><img src="javascript:x"><img src="/sprite.png"><img src="/sprites.png"><img src="/a/1x1.gif"><img src="/pixel/a.jpg"><img src="/flat.jpg" width="300" height="2">',
        '<img src="/wide', k, '.jpg" width="', size, '" height="300"><img src="/logo', k, '.png" width="', size + 40, '" height="64"><img src="/icon.png" width="64" height="64"><img src="/bigicon.png" width="65" height="64"><img src="/photo.png" width="64" height="64">',
    )
    pages = read(spark, d, "part").select("p_partkey", F.lit("https://i.example.com/a").alias("url"), html.alias("html"))
    return scan(pages, ["dom_images"]).select("p_partkey", F.explode("dom_images").alias("a")).select("p_partkey", "a.url", "a.width")


@query(_SCORED + " SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, weight DESC, width * height DESC, pos) - 1 AS ord, same AS alike, CASE WHEN same > 1 THEN least((same - 1) * 4, 12) ELSE 0 END AS penalty FROM s")
def duplicate_penalty(spark, d):
    """What pictures lose to others of the same file, as their reasons tell."""
    lost = F.regexp_extract(F.array_join("reasons", ";"), r"duplicate-like URL group subtracted (\d+)", 1)
    return scored_lines(spark, d).select("l_orderkey", col("ord").cast("bigint").alias("ord"), col("alike").cast("bigint").alias("alike"), F.coalesce(F.nullif(lost, F.lit("")), F.lit("0")).cast("bigint").alias("penalty"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'openGraph' WHEN 1 THEN 'twitter' WHEN 2 THEN 'embeddedData' ELSE 'html' END AS title, CASE p_partkey % 5 WHEN 0 THEN 'openGraph' WHEN 1 THEN 'twitter' WHEN 2 THEN 'embeddedData' WHEN 3 THEN 'html' END AS description,
CASE p_partkey % 5 WHEN 0 THEN 'openGraph' WHEN 2 THEN 'embeddedData' END AS author, CASE p_partkey % 5 WHEN 0 THEN 'openGraph' WHEN 1 THEN 'twitter' WHEN 3 THEN 'html' END AS image FROM part""")
def source_attribution(spark, d):
    """Where the fields of a record come from."""
    k = col("p_partkey")
    shapes = [
        '<meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="/o.jpg"><meta property="article:author" content="A">',
        '<meta name="twitter:title" content="T"><meta name="twitter:description" content="D"><meta name="twitter:image" content="/t.jpg">',
        '<script type="application/json">{"title":"A title","description":"A text of it","author":{"name":"N"}}</script>',
        '<meta name="description" content="D"><img src="/h.jpg">',
        "",
    ]
    html = text("<title>Plain ", k, "</title>", F.get(F.array(*map(F.lit, shapes)), (k % len(shapes)).cast("int")))
    pages = read(spark, d, "part").select("p_partkey", F.lit("https://f.example.com/").alias("url"), html.alias("html"))
    return Engine().parse(pages).select("p_partkey", *[col("sources")[f].alias(f) for f in ("title", "description", "author", "image")])
