"""From scanned pages to records: what each field is taken from, in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.js import defined, number_of
from metaloom.functions.kept import kept
from metaloom.functions.urls import domain_of, on_reddit
from metaloom.operators import adapters, assets, quality, state, tags
from metaloom.operators.adapters import PERSON, RESULT
from metaloom.sources.pages import ENTITY

NO_RESULTS = f"array<{RESULT}>"
CARD = ("card", "site", "creator", "title", "description")


@kept
def _raw_tags() -> dict[str, Column]:
    return {"og_raw": tags.pairs("property", "og:", "article:", "product:"), "card_raw": tags.pairs("name", "twitter:")}


@kept
def _tags() -> dict[str, Column]:
    og, card = F.col("og_raw"), F.col("card_raw")
    of = lambda key: tags.first(og, key)
    url = F.get(F.filter(og, lambda m: m.key == "og:url"), 0)
    return {
        "og": F.struct(
            *[of(f"og:{k}").alias(k) for k in ("title", "description", "type", "site_name", "locale", "determiner")],
            url.content.alias("raw_url"), url.resolved.alias("url"),
            tags.graph_assets(tags.graph_media(og, "image"), "image").alias("images"), tags.graph_assets(tags.graph_media(og, "video"), "video").alias("videos"), tags.graph_assets(tags.graph_media(og, "audio"), "audio").alias("audio"),
            of("article:published_time").alias("published"), of("article:modified_time").alias("modified"), of("article:expiration_time").alias("expires"), of("article:section").alias("section"),
            tags.values(og, "article:tag").alias("tags"), tags.values(og, "article:author").alias("authors"),
            *[of(f"product:{k}").alias(n) for k, n in (("price:amount", "price"), ("price:currency", "currency"), ("availability", "availability"), ("condition", "condition"))],
        ),
        "card": F.when(F.size(card) == 0, F.struct(*[F.lit(None).cast("string").alias(k) for k in CARD], assets.none().alias("images"), assets.none().alias("videos"))).otherwise(
            F.struct(*[tags.first(card, f"twitter:{k}").alias(k) for k in CARD], tags.card_images(card).alias("images"), tags.card_videos(card).alias("videos"))
        ),
        "html": F.struct(
            F.coalesce("title", tags.meta_named(("name", "title"))).alias("title"), tags.meta_named(("name", "description"), ("itemprop", "description")).alias("description"), tags.keywords().alias("keywords"),
            tags.meta_named(("name", "robots")).alias("robots"), tags.canonical().alias("rawCanonicalUrl"), F.try_element_at(F.transform(tags.links_with("canonical"), lambda x: x.resolved), F.lit(-1)).alias("canonicalUrl"),
            F.get(F.filter("links", lambda x: x.rel_text == "manifest"), 0).href.alias("manifestUrl"), tags.meta_named(("name", "theme-color")).alias("themeColor"),
            tags.meta_named(("name", "application-name"), ("name", "apple-mobile-web-app-title")).alias("applicationName"), tags.favicons().alias("favicons"), tags.image_src().alias("imageSrc"), tags.alternates().alias("alternates"),
        ),
        "oembed_links": tags.oembed_links(),
    }


def with_tags(scanned: DataFrame) -> DataFrame:
    """Adds og, card, html and oembed_links to a scan."""
    return scanned.withColumns(_raw_tags()).withColumns(_tags()).drop("title")


def _candidates(ext: Column | None) -> tuple[Column, Column, Column]:
    """All candidates of a page in order of their sources; ext are the results of plugins and adapters."""
    outer = lambda field: [F.flatten(F.transform(ext, lambda r: F.coalesce(r[field], assets.none())))] if ext is not None else []
    col = F.col
    images = F.concat(*outer("images"), col("og.images"), col("card.images"), col("json_images"), col("html.imageSrc"), col("dom_images"), col("oembed_images"))
    videos = F.concat(*outer("videos"), col("og.videos"), col("card.videos"), col("json_videos"), col("dom_videos"))
    audio = F.concat(*outer("audio"), col("og.audio"), col("json_audio"), col("dom_audio"))
    return images, videos, audio


@kept
def _domain() -> dict[str, Column]:
    return {"site_domain": domain_of(F.col("final_url"))}


@kept
def _reddit() -> dict[str, Column]:
    return {"site_reddit": on_reddit(F.col("site_domain"))}


@kept
def _once() -> dict[str, Column]:
    return {"found": F.struct(*[c.alias(k) for k, c in assets.discovered(*_candidates(None), F.col("site_reddit")).items()])}


@kept
def _of_sites(sites: tuple[adapters.Adapter, ...]) -> dict[str, Column]:
    return adapters.page_columns(list(sites))


@kept
def _site_media() -> dict[str, Column]:
    of_site = lambda c: F.when(F.col("site_adapter").isNotNull(), adapters.marked(c, F.col("site_adapter")))
    return {"site_images": of_site(F.col("found.images")), "site_videos": of_site(F.col("found.videos"))}


@kept
def _site_results(sites: tuple[adapters.Adapter, ...]) -> dict[str, Column]:
    return {"adapter_results": adapters.results(list(sites))}


@kept
def _again() -> dict[str, Column]:
    again = assets.discovered(*_candidates(F.col("ext")), F.col("site_reddit"))
    # Without media of others the media are those found already.
    given = F.exists("ext", lambda r: F.greatest(*[F.coalesce(F.size(r[k]), F.lit(0)) for k in ("images", "videos", "audio")]) > 0)
    return {"media": F.when(~given, F.col("found")).otherwise(F.struct(*[c.alias(k) for k, c in again.items()]))}


@kept
def _pictures(scorers: tuple) -> dict[str, Column]:
    return {"pictures": assets.scored(F.col("media.images"), scorers)}


def with_media(tagged: DataFrame, sites: list[adapters.Adapter], plugins: list[Column], scorers: tuple = ()) -> DataFrame:
    """Adds ext (the results of plugins, then of matching adapters), found (media) and best."""
    if "oembed_images" not in tagged.columns:
        tagged = tagged.withColumns({"oembed_images": assets.none(), "oembed_warnings": F.array().cast("array<string>")})
    own = F.filter(F.array(*[p.cast(RESULT) for p in plugins]), lambda r: r.isNotNull()) if plugins else F.array().cast(NO_RESULTS)
    found = tagged.withColumns(_domain()).withColumns(_reddit()).withColumns(_once()).withColumns(_of_sites(tuple(sites))).withColumns(_site_media())
    found = found.withColumns({"plugin_results": own} | _site_results(tuple(sites))).withColumn("ext", F.concat("plugin_results", "adapter_results"))
    return found.withColumns(_again()).withColumns(_pictures(tuple(scorers))).withColumn("best", F.get("pictures", F.lit(0)))


def _ext(field: str) -> Column:
    return F.get(F.filter("ext", lambda r: r[field].isNotNull()), 0)[field]


def _entity(name: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("logo"), F.lit(None).cast("array<string>").alias("sameAs"))


def _or_null(struct: Column, *fields: Column) -> Column:
    """Null if no field is there."""
    return F.when(F.coalesce(*[f.cast("string") for f in fields]).isNotNull(), struct)


def _filled(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def _last_part(text: Column) -> Column:
    return F.try_element_at(F.filter(F.split(text, "/"), lambda s: s != ""), F.lit(-1))


def _article() -> Column:
    node, og = F.col("n_article"), F.col("og")
    authors = F.coalesce(_filled(F.transform(og.authors, _entity)), node.authors, F.when(F.col("e_author").isNotNull(), F.array(F.col("e_author"))))
    f = {
        "headline": defined(node.headline, state.best_text("headline", "title", "postTitle", "pinTitle", "projectTitle"), og.title),
        "section": defined(og.section, node.section),
        "tags": _filled(F.array_distinct(F.filter(F.concat(og.tags, F.coalesce(node.keywords, F.array().cast("array<string>"))), lambda t: t != ""))),
        "publishedTime": defined(_ext("publishedTime"), og.published, node.published, state.best_text("datePublished", "publishedTime", "published_at", "createdAt", "created_at", "timestamp")),
        "modifiedTime": defined(og.modified, node.modified),
        "expirationTime": og.expires,
        "authors": authors.cast(f"array<{ENTITY}>"),
        "publisher": F.coalesce(node.publisher, F.col("e_publisher")).cast(ENTITY),
    }
    return _or_null(F.struct(*[c.alias(k) for k, c in f.items()]), *f.values())


def _product() -> Column:
    node = F.col("n_product")
    f = {
        "name": node["name"], "brand": node.brand, "sku": node.sku, "price": node.price, "currency": node.currency, "availability": _last_part(node.availability), "condition": _last_part(node.condition),
        "ratingValue": number_of(node.rating), "reviewCount": number_of(node.reviews),
    }
    return _or_null(F.struct(*[c.alias(k) for k, c in f.items()]), *f.values())


def _app() -> Column:
    node = F.col("n_app")
    f = {"name": defined(F.col("html.applicationName"), node["name"]), "category": node.category, "operatingSystem": node.system, "price": node.price, "currency": node.currency}
    return _or_null(F.struct(*[c.alias(k) for k, c in f.items()]), *f.values())


def _video() -> Column:
    """Given by an adapter, or trusted unless another kind of page is explicit; without anything that identifies it, none."""
    ext, node, og, kind = _ext("video"), F.col("n_video"), F.col("og"), _ext("type")
    trusted = kind.isNull() | kind.isin("video", "playlist") | F.coalesce(F.contains(F.lower(og.type), F.lit("video")), F.lit(False)) | node.isNotNull()
    f = {
        "id": defined(ext.id, node.video_id, state.best_text("videoId", "video_id")),
        "title": defined(ext.title, node["name"], og.title, state.best_text("videoTitle", "title")),
        "channel": F.coalesce(ext.channel.cast(PERSON), state.first_entity("channel", "ownerchannelname", "author").cast(PERSON)),
        "publishedTime": defined(ext.publishedTime, node.uploaded, state.best_text("publishDate", "publishedTime", "uploadDate", "datePublished")),
        "duration": defined(ext.duration, node.duration, state.best_text("duration", "lengthSeconds")),
        "tags": F.coalesce(ext.tags, state.first_list("tags", "keywords")),
        "category": defined(ext.category, state.best_text("category")),
        "viewCount": F.coalesce(ext.viewCount.cast("double"), number_of(state.best_text("viewCount", "views"))),
    }
    known = F.coalesce(f["id"], f["duration"], f["channel"].cast("string"), f["publishedTime"]).isNotNull() | (F.size("media.videos") > 0) | (F.size("og.videos") > 0) | (F.size("card.videos") > 0) | node.isNotNull()
    return F.when(ext.isNotNull() | (trusted & known), _or_null(F.struct(*[c.alias(k) for k, c in f.items()]), *f.values()))


def _type() -> Column:
    kind = F.lower("og.type")
    says = lambda word: F.coalesce(F.contains(kind, F.lit(word)), F.lit(False))
    there = lambda name: F.col(name).isNotNull()
    return F.coalesce(
        _ext("type"),
        F.when(_ext("playlist").isNotNull(), "playlist")
        .when(says("article") | there("article"), "article")
        .when(says("product") | there("product") | state.has_node("Product"), "product")
        .when(says("image") | state.has_node("ImageObject"), "image")
        .when(says("video") | (F.size("media.videos") > 0) | state.has_node("VideoObject"), "video")
        .when(says("audio") | (F.size("media.audio") > 0) | state.has_node("AudioObject", "MusicRecording", "PodcastEpisode"), "audio")
        .when(there("app") | state.has_node("SoftwareApplication", "MobileApplication", "WebApplication"), "app")
        .when(says("profile") | state.has_node("Person"), "profile")
        .when(F.col("og.type").isNotNull() | F.col("html.title").isNotNull(), "website")
        .otherwise("unknown"),
    )


def _sources_used() -> Column:
    some = lambda name: F.size(name) > 0
    html = F.col("html.title").isNotNull() | F.col("html.description").isNotNull() | F.col("html.rawCanonicalUrl").isNotNull()
    head = [(some("og_raw"), "openGraph"), (some("card_raw"), "twitter"), (some("jsonld"), "jsonLd"), (some("embedded"), "embeddedData")]
    tail = [(some("oembed_links"), "oEmbed"), (html, "html"), (some("dom_images") | some("dom_videos") | some("dom_audio"), "media")]
    named = lambda pairs: F.array(*[F.when(test, F.lit(name)) for test, name in pairs])
    sources = lambda results: F.transform(results, lambda r: r.source)
    every = F.concat(named(head), F.transform("embedded", lambda e: e.source), named(tail), sources("adapter_results"), sources("plugin_results"))
    return F.array_distinct(F.filter(every, lambda s: s.isNotNull()))


def _attribution() -> Column:
    by = lambda field: F.get(F.filter("ext", lambda r: r[field].isNotNull()), 0).source
    given = lambda c, name: F.when(c.isNotNull(), F.lit(name))
    col = F.col
    return F.struct(
        F.coalesce(by("title"), given(col("og.title"), "openGraph"), given(col("card.title"), "twitter"), given(state.best_text("title", "headline", "name"), "embeddedData"), given(col("html.title"), "html")).alias("title"),
        F.coalesce(by("description"), given(col("og.description"), "openGraph"), given(col("card.description"), "twitter"), given(state.best_text("description", "summary", "excerpt"), "embeddedData"), given(col("html.description"), "html")).alias("description"),
        F.coalesce(by("author"), given(col("e_author"), "embeddedData"), F.when(F.size("og.authors") > 0, F.lit("openGraph"))).alias("author"),
        assets.label(col("best")).alias("image"),
    )


def _trace() -> Column:
    some = lambda name: F.size(name) > 0
    media = some("dom_images") | some("dom_videos") | some("dom_audio")
    outer = F.exists("ext", lambda r: (F.coalesce(F.size(r.images), F.lit(0)) > 0) | (F.coalesce(F.size(r.videos), F.lit(0)) > 0))
    lines = [
        (F.lit(True), "validated and normalized URL"), (some("og_raw"), "parsed Open Graph"), (some("card_raw"), "parsed Twitter Cards"), (some("jsonld"), "parsed JSON-LD"),
        (some("embedded"), "parsed embedded application data"), (some("oembed_links"), "discovered oEmbed endpoints"), (media, "discovered HTML media candidates"),
    ]
    more = [
        (some("og.images"), "media discovery collected og:image candidates"), (some("card.images"), "media discovery collected twitter:image candidates"), (some("jsonld"), "media discovery scanned JSON-LD media"),
        (some("embedded"), "media discovery scanned embedded application data"), (some("dom_images"), "media discovery scanned HTML images, srcset, lazy images, posters, and fallbacks"), (outer, "media discovery included adapter and plugin media"),
    ]
    said = lambda pairs: F.array(*[F.when(test, F.lit(text)) for test, text in pairs])
    matched = lambda of, text: F.transform(of, lambda r: F.concat(F.lit(text), r.source))
    last = F.array(F.when(F.col("best").isNotNull(), F.concat(F.lit("selected image from "), assets.label(F.col("best")))))
    every = F.concat(said(lines), matched("plugin_results", "plugin extractor matched: "), matched("adapter_results", "adapter matched: "), said(more), last)
    return F.array_distinct(F.filter(every, lambda s: s.isNotNull()))


@kept
def _nodes() -> dict[str, Column]:
    return {
        "n_article": state.node_of("Article", "NewsArticle", "BlogPosting"), "n_product": state.node_of("Product"), "n_app": state.node_of("SoftwareApplication", "MobileApplication", "WebApplication"),
        "n_site": state.node_of("Organization", "NewsMediaOrganization", "WebSite"), "n_video": state.node_of("VideoObject"),
        "e_author": state.first_entity("author", "creator", "owner", "user"), "e_publisher": state.first_entity("publisher", "provider", "organization"),
    }


@kept
def _own(warnings: tuple[str, ...], more: tuple[str, ...]) -> dict[str, Column]:
    col = F.col
    nodes = [col(n) for n in ("n_article", "n_product", "n_app", "n_site")]
    pair = lambda text, resolved: F.when(F.coalesce(text, F.lit("")) != "", F.struct(text.alias("text"), resolved.alias("resolved")))
    linked = F.get(F.filter("jsonld", lambda n: n.url.isNotNull()), 0)
    canonical = F.coalesce(pair(_ext("canonicalUrl"), _ext("canonicalUrl")), pair(col("html.rawCanonicalUrl"), col("html.canonicalUrl")), pair(col("og.raw_url"), col("og.url")), pair(linked.url, linked.resolved), state.best_link("canonicalUrl", "canonical", "permalink", "pageUrl", "shareUrl")).resolved
    return {
        "canonical_url": canonical,
        "title": defined(_ext("title"), col("og.title"), col("card.title"), *[n.headline for n in nodes], *[n["name"] for n in nodes], state.best_text("title", "headline", "pageTitle", "ogTitle", "name"), col("html.title")),
        "description": defined(_ext("description"), col("og.description"), col("card.description"), *[n.description for n in nodes], state.best_text("description", "excerpt", "summary", "subtitle", "ogDescription"), col("html.description")),
        "site_name": defined(_ext("siteName"), col("og.site_name"), col("n_site")["name"], state.best_text("siteName", "site_name", "appName", "applicationName"), col("site_domain")),
        "article": _article(), "product": _product(), "app": _app(), "video": _video(), "playlist": _ext("playlist"), "sources_used": _sources_used(),
        "warnings": F.array_distinct(F.concat(F.array(*map(F.lit, warnings)).cast("array<string>"), col("jsonld_warnings"), *[F.coalesce(c, F.array().cast("array<string>")) for c in more], col("oembed_warnings"))), "sources": _attribution(), "trace": _trace(),
    }


@kept
def _people() -> dict[str, Column]:
    col = F.col
    return {
        "type": _type(),
        "author": F.coalesce(_ext("author").cast(ENTITY), F.get("article.authors", F.lit(0)), col("e_author")),
        "publisher": F.coalesce(col("article.publisher"), _ext("publisher").cast(ENTITY), col("n_site").self, col("e_publisher")),
        "publish_date": defined(col("article.publishedTime"), col("video.publishedTime")),
    }


@kept
def _scores() -> dict[str, Column]:
    col = F.col
    first = F.get("adapter_results", F.lit(0))
    has_media = (F.coalesce(F.size(first.images), F.lit(0)) > 0) | (F.coalesce(F.size(first.videos), F.lit(0)) > 0)
    worked = F.exists("adapter_results", lambda r: r.title.isNotNull() | r.description.isNotNull() | (F.coalesce(F.size(r.images), F.lit(0)) > 0) | (F.coalesce(F.size(r.videos), F.lit(0)) > 0))
    structured, stated = F.size("jsonld") > 0, F.size("embedded") > 0
    media = F.size("media.images") + F.size("media.videos") + F.size("media.audio")
    there = lambda name: col(name).isNotNull()
    return {
        "confidence": quality.confidence(col("title"), col("description"), col("best.score"), col("best.source"), col("canonical_url"), structured, worked, F.size("og_raw") > 0, F.size("card_raw") > 0, stated, F.size("warnings")),
        "completeness": quality.completeness(title=there("title"), description=there("description"), image=there("best"), canonical=there("canonical_url"), site=there("site_name"), author=there("author"), publisher=there("publisher"), type=col("type") != "unknown", published=there("publish_date"), media=media > 1),
        "confidence_breakdown": quality.breakdown(col("title"), col("description"), col("best.score"), col("best.source"), structured, stated, F.when(worked, quality.adapter_confidence(first.title, first.description, has_media, first.author)).otherwise(0)),
        "adapter": F.struct(first.isNotNull().alias("matched"), first.source.alias("name"), F.when(first.isNotNull(), quality.adapter_confidence(first.title, first.description, has_media, first.author, *quality.DIAGNOSTIC)).alias("confidence")),
        "method": F.coalesce(first.method, col("sources.title")),
    }


@kept
def _reliability() -> dict[str, Column]:
    return {"reliability": quality.reliability(F.col("confidence"), F.col("completeness"), F.size("adapter_results") > 0, F.col("best.score"), F.size("warnings"))}


def with_fields(df: DataFrame, warnings: list[str] = (), more: list[str] = ()) -> DataFrame:
    """Adds the record's fields to the columns of with_media(); warnings are the same for all rows, more names columns that hold others."""
    return df.withColumns(_nodes()).withColumns(_own(tuple(warnings), tuple(more))).withColumns(_people()).withColumns(_scores()).withColumns(_reliability())
