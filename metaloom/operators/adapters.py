"""Adapters of known sites: for pages of a site one struct of what it says about them, null for all other pages.

A page's host decides, so rows of other hosts do no adapter work. The columns of the scan, the tags and the discovered media
must be there (see metaloom.plans.api). Result columns: RESULT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.bound import bound
from metaloom.functions.js import squashed
from metaloom.functions.urls import domain_of, host_is, path_of, query_value, youtube_id
from metaloom.operators.assets import none, unique_by_url
from metaloom.operators.state import best_of, best_site_text
from metaloom.sources.media import ASSET
from metaloom.sources.sites import HOSTS

PERSON = "struct<name:string,url:string,logo:string,sameAs:array<string>>"
VIDEO = f"struct<id:string,title:string,channel:{PERSON},publishedTime:string,duration:string,tags:array<string>,category:string,viewCount:bigint>"
PLAYLIST = f"struct<id:string,title:string,channel:{PERSON},videos:array<struct<id:string,title:string,url:string>>>"
#: The shape that adapters and plugins share.
RESULT = f"struct<source:string,type:string,title:string,description:string,siteName:string,canonicalUrl:string,author:{PERSON},publisher:{PERSON},publishedTime:string,images:array<{ASSET}>,videos:array<{ASSET}>,audio:array<{ASSET}>,video:{VIDEO},playlist:{PLAYLIST},method:string,identifiers:map<string,string>>"

_DESCRIPTION = ("description", "desc", "summary", "excerpt", "caption", "text")
_PUBLISHED = ("datePublished", "publishedTime", "published_at", "createdAt", "created_at", "uploadDate", "timestamp")
_REDDIT_STATE = ("applicationJson", "jsonScript", "initialState", "preloadedState", "nextData")
_LOW_QUALITY = r"(?i)\{[^}]+\}|tiktok\s*shop|free shipping|eligible items|exclusive collections|^tiktok live creator networks$|^tiktok\s*-\s*make your day$|^discover (?:new |popular )?videos?\b.*\btiktok\b"


def result(**fields: Column) -> Column:
    """A RESULT from some of its fields."""
    names = ["source", "type", "title", "description", "siteName", "canonicalUrl", "author", "publisher", "publishedTime", "images", "videos", "audio", "video", "playlist", "method", "identifiers"]
    kinds = dict(zip(names, _kinds(RESULT), strict=True))
    return F.struct(*[fields.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names])


def _kinds(ddl: str) -> list[str]:
    """The types of a struct's fields."""
    out, depth, start = [], 0, 0
    inner = ddl[len("struct<") : -1]
    for i, c in enumerate(inner + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[start:i].split(":", 1)[1])
            start = i + 1
    return out


def marked(assets: Column, adapter: Column) -> Column:
    """Assets as the adapter's own, each URL once; the source that they came from is kept."""
    return F.transform(unique_by_url(assets), lambda a: a.withField("metadata", a.metadata.withField("adapter", adapter).withField("originalSource", F.coalesce(a.metadata.originalSource, a.source))).withField("source", F.lit("adapter")))


def _person(p: Column) -> Column:
    return F.when(p.isNotNull(), F.struct(p["name"].alias("name"), p.url.alias("url"), p.logo.alias("logo"), F.lit(None).cast("array<string>").alias("sameAs")))


def _named(name: Column, url: Column | None = None) -> Column:
    return F.when(name.isNotNull(), F.struct(name.alias("name"), (F.lit(None) if url is None else url).cast("string").alias("url"), F.lit(None).cast("string").alias("logo"), F.lit(None).cast("array<string>").alias("sameAs")))


def _found(of: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(of, pattern, 1), F.lit(""))


def _first(*choices: tuple[Column, str]) -> tuple[Column, Column]:
    """The first text there is, and the name of its origin."""
    value, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, name in reversed(choices):
        value, method = F.when(text.isNotNull(), text).otherwise(value), F.when(text.isNotNull(), F.lit(name)).otherwise(method)
    return value, method


def _ids(**ids: Column) -> Column:
    every = F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*ids.values()))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def page_columns(adapters: list[Adapter]) -> dict[str, Column]:
    """What several adapters read, each computed once; null for pages of no adapter's site. Texts are the best ones, whichever the source. Reads site_domain."""
    name = F.coalesce(*[F.when(fits(test), F.lit(n)) for n, test, _ in adapters], F.lit(None).cast("string"))
    of_site = lambda c: F.when(F.col("site").isNotNull(), c)
    return {
        "site_adapter": name,
        "site_fits": F.array(*[F.coalesce(fits(test), F.lit(False)) for _, test, _ in adapters]).cast("array<boolean>"),
        "site_path": path_of(F.col("final_url")),
        "site_published": of_site(best_of(F.col("og.published"), F.col("site.published"), best_site_text(_PUBLISHED))),
        "site_description": of_site(best_of(F.col("og.description"), F.col("card.description"), best_site_text(_DESCRIPTION), F.col("html.description"))),
    }


class Page:
    """Columns that adapters read."""

    def __init__(self):
        self.url, self.path = F.col("final_url"), F.col("site_path")
        self.images, self.videos = F.col("site_images"), F.col("site_videos")
        self.site, self.published, self.description = F.col("site"), F.col("site_published"), F.col("site_description")

    def title(self, *keys: str) -> Column:
        return best_of(F.col("og.title"), F.col("card.title"), best_site_text(keys), F.col("html.title"))

    def plain(self, adapter: str, name: str, kind: Column, keys: tuple[str, ...], **ids: Column) -> Column:
        return result(
            source=F.lit(adapter), type=kind, title=self.title(*keys), description=self.description, siteName=F.lit(name), canonicalUrl=F.col("og.url"), author=_person(self.site.person),
            publishedTime=self.published, images=self.images, videos=self.videos, identifiers=_ids(**ids),
        )


def youtube(p: Page) -> Column:
    id_, list_, post = youtube_id(p.url), query_value(p.url, "list"), _found(p.path, r"/post/([^/?]+)")
    html = F.regexp_replace(F.col("html.title"), r"(?i)\s*-\s*YouTube\s*$", "")
    prefix = "youtube:"
    title, method = _first((p.site.ld_video_title, prefix + "structuredData.VideoObject"), (p.site.player_title, prefix + "ytInitialPlayerResponse"), (p.site.initial_title, prefix + "ytInitialData"), (F.col("og.title"), prefix + "openGraph"), (F.col("card.title"), prefix + "twitter"), (html, prefix + "html"))
    text = F.coalesce(p.site.ld_video_description, p.site.player_description, p.site.initial_description, F.col("og.description"), F.col("card.description"), F.col("html.description"))
    channel = _person(p.site.person)
    video = F.struct(
        id_.alias("id"), title.alias("title"), channel.alias("channel"), p.published.alias("publishedTime"), best_site_text(("duration", "lengthSeconds", "approxDurationMs")).alias("duration"),
        p.site.tags.alias("tags"), best_site_text(("category",)).alias("category"), p.site["views"].alias("viewCount"),
    )
    playlist = F.struct(list_.alias("id"), F.coalesce(p.site.playlist_title, F.col("og.title")).alias("title"), channel.alias("channel"), p.site.playlist.alias("videos"))
    return result(
        source=F.lit("youtubeAdapter"), type=F.when(list_.isNotNull(), "playlist").when(post.isNotNull(), "social_post").otherwise("video"), siteName=F.lit("YouTube"),
        canonicalUrl=F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), id_), F.col("og.url")), title=title, description=text, author=channel, publishedTime=p.published,
        images=p.images, videos=p.videos, video=F.when(id_.isNotNull(), video), playlist=F.when(list_.isNotNull(), playlist),
        method=F.coalesce(method, F.lit(prefix + "htmlFallback")), identifiers=_ids(videoId=id_, playlistId=list_, communityPostId=post),
    )


def reddit_parts(url: Column) -> dict[str, Column]:
    """subreddit, postId and username of a Reddit URL."""
    return _reddit_parts(_segments(path_of(url)), domain_of(url))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _reddit_parts(parts: Column, domain: Column) -> dict[str, Column]:
    at = F.array_position(parts, "comments").cast("int")
    short = F.when(host_is(domain, "redd.it"), F.get(parts, 0))
    after = lambda word: F.when(F.get(parts, 0) == word, F.get(parts, 1))
    return {"subreddit": after("r"), "postId": F.when(at > 0, F.get(parts, at)).otherwise(short), "username": after("user"), "isPost": (at > 0) | short.isNotNull()}


def reddit(p: Page) -> Column:
    said = best_site_text(("postTitle", "title", "headline"), _REDDIT_STATE)
    text = F.coalesce(best_site_text(("description", "selftext", "excerpt", "summary", "body"), _REDDIT_STATE), p.site.ld_post_description, F.col("og.description"), F.col("card.description"), F.col("html.description"))
    found = F.struct(_segments(p.path).alias("parts"), said.alias("said"), squashed(text).alias("text"))
    return bound(found, lambda x: _reddit(p, x))


def _reddit(p: Page, x: Column) -> Column:
    """x holds what several fields read: the parts of the path, the title that the page's data state, and the text."""
    of = _reddit_parts(x.parts, F.col("site_domain"))
    state = F.when(p.site.reddit_payload, "reddit:jsonEndpoint").otherwise("reddit:embeddedStructuredData")
    title, method = _first((x.said, "state"), (p.site.ld_post_title, "reddit:structuredData"), (F.col("og.title"), "reddit:openGraph"), (F.col("card.title"), "reddit:twitter"), (F.col("html.title"), "reddit:html"))
    clean = F.trim(F.regexp_replace(title, r"(?i)\s*:\s*r/[A-Za-z0-9_]+$", ""))
    clean = bound(clean, lambda c: F.when(~c.rlike("(?i)please wait for verification|whoa there, pardner"), F.nullif(c, F.lit(""))))
    text = F.when(~x.text.rlike("(?i)please wait for verification|whoa there, pardner|request has been blocked"), x.text)
    return result(
        source=F.lit("redditAdapter"), type=F.when(of["isPost"], "social_post").otherwise("website"), siteName=F.lit("Reddit"), canonicalUrl=F.coalesce(F.col("og.url"), F.col("html.canonicalUrl")), title=clean, description=text,
        author=F.coalesce(_named(of["username"]), _person(p.site.person)), publishedTime=p.published, images=p.images, videos=p.videos,
        method=F.when(method == "state", state).otherwise(F.coalesce(method, F.lit("reddit:htmlFallback"))), identifiers=_ids(**{k: of[k] for k in ("subreddit", "postId", "username")}),
    )


def pinterest(p: Page) -> Column:
    pin = _found(p.path, r"/pin/([^/]+)")
    kind = F.when(pin.isNotNull() | host_is(domain_of(p.url), "pin.it"), "social_post").otherwise("image")
    return p.plain("pinterestAdapter", "Pinterest", kind, ("title", "pinTitle", "gridTitle", "headline", "name"), pinId=pin)


def behance(p: Page) -> Column:
    project = _found(p.path, r"/gallery/(\d+)")
    return p.plain("behanceAdapter", "Behance", F.when(project.isNotNull(), "image").otherwise("website"), ("title", "projectTitle", "name", "headline"), projectId=project)


def tiktok(p: Page) -> Column:
    user = _found(p.path, "@([^/]+)")
    post = F.coalesce(_found(p.path, r"/(?:video|photo)/([^/]+)"), F.try_element_at(F.filter(F.split(p.path, "/"), lambda s: s != ""), F.lit(-1)))
    clean = lambda text: F.when(~squashed(text).rlike(_LOW_QUALITY), squashed(text))
    title, method = _first((p.site.item_text, "tiktok:itemStruct.desc"), (p.site.item_music, "tiktok:itemStruct.music"), (clean(p.title("desc", "caption", "title", "description")), "tiktok:fallback"), (F.concat(F.lit("TikTok post by @"), user), "tiktok:urlFallback"))
    text = F.coalesce(p.site.item_text, clean(p.description))
    when = F.coalesce(p.site.item_published, p.published)
    author = _person(p.site.item_person)
    video = F.struct(post.alias("id"), title.alias("title"), author.alias("channel"), when.alias("publishedTime"), p.site.item_duration.alias("duration"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("category"), p.site.item_plays.alias("viewCount"))
    with_own = lambda own, found: F.concat(F.coalesce(own, none()), found)
    return result(
        source=F.lit("tiktokAdapter"), type=F.lit("social_post"), siteName=F.lit("TikTok"), canonicalUrl=F.col("og.url"), title=title, description=text, author=author, publishedTime=when,
        images=marked(with_own(p.site.item_images, p.images), F.lit("tiktokAdapter")), videos=marked(with_own(p.site.item_videos, p.videos), F.lit("tiktokAdapter")), video=F.when(post.isNotNull(), video),
        method=F.coalesce(method, F.lit("tiktok:fallback")), identifiers=_ids(username=user, postId=post),
    )


def facebook(p: Page) -> Column:
    story = query_value(p.url, "story_fbid")
    post = p.path.rlike("(?i)/(?:posts|photo|videos|watch|reel|share)/") | p.url.rlike(r"[?&]story_fbid=")
    photo = F.contains(p.path, F.lit("photo.php")) | p.url.rlike(r"[?&]fbid=")
    kind = F.when(photo, "image").when(post | (F.size(p.images) > 0) | (F.size(p.videos) > 0), "social_post").otherwise("website")
    return p.plain("facebookAdapter", "Facebook", kind, ("title", "headline", "name"), postId=F.coalesce(story, _found(p.path, r"/(?:posts|videos|reel)/([^/]+)")))


def twitter(p: Page) -> Column:
    status = _found(p.path, r"/status(?:es)?/(\d+)")
    kind = F.when(status.isNotNull() | host_is(domain_of(p.url), "t.co"), "social_post").otherwise("profile")
    return p.plain("twitterAdapter", "X", kind, ("title", "full_text", "text", "headline"), statusId=status)


def instagram(p: Page) -> Column:
    code = _found(p.path, r"/(?:p|reel|tv)/([^/]+)")
    return p.plain("instagramAdapter", "Instagram", F.when(code.isNotNull(), "social_post").otherwise("profile"), ("title", "caption", "edge_media_to_caption", "headline"), shortcode=code)


class OnHosts:
    """Whether a URL's host is one of some domains or below one."""

    def __init__(self, *domains: str):
        self.domains = domains

    def __call__(self, url: Column) -> Column:
        return self.holds(domain_of(url))

    def holds(self, domain: Column) -> Column:
        return host_is(domain, *self.domains)


def fits(test: Callable[[Column], Column]) -> Column:
    """Whether an adapter handles a page; its domain is read from the URL once, as many adapters ask for it."""
    return test.holds(F.col("site_domain")) if isinstance(test, OnHosts) else test(F.col("final_url"))


Adapter = tuple[str, Callable[[Column], Column], Callable[[Page], Column]]
#: (name, whether it handles a URL, its result).
DEFAULT: list[Adapter] = [(f"{f.__name__}Adapter", OnHosts(*HOSTS[f.__name__]), f) for f in (youtube, reddit, pinterest, behance, tiktok, facebook, twitter, instagram)]


def results(adapters: list[Adapter]) -> Column:
    """The results of all adapters that handle a page, in order."""
    page, empty = Page(), F.array().cast(f"array<{RESULT}>")
    if not adapters:
        return empty
    every = F.array(*[F.when(F.get("site_fits", F.lit(i)), make(page)) for i, (_, _, make) in enumerate(adapters)])
    return F.when(F.col("site_adapter").isNotNull(), F.filter(every, lambda r: r.isNotNull())).otherwise(empty)

