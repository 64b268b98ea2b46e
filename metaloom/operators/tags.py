"""What a page's head says, as Column expressions over the scan: meta tags, cards, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.js import defined, integer_of, squashed
from metaloom.operators.assets import asset, none

_MEDIA = "struct<url:string,resolved:string,secure:string,type:string,width:double,height:double,alt:string>"


def _key(m: Column, first: str) -> Column:
    return F.coalesce(m[first], m["property" if first == "name" else "name"])


def pairs(first: str, *prefixes: str) -> Column:
    """(key, content, resolved) of meta tags whose key starts with one of the prefixes; first is the attribute that names the key."""
    named = F.transform("metas", lambda m: F.struct(_key(m, first).alias("key"), m.content.alias("content"), m.resolved.alias("resolved")))
    starts = lambda k: _any([F.startswith(k, F.lit(p)) for p in prefixes])
    return F.filter(named, lambda m: starts(m.key))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def values(of: Column, key: str) -> Column:
    return F.transform(F.filter(of, lambda m: m.key == key), lambda m: m.content)


def first(of: Column, key: str) -> Column:
    return F.get(values(of, key), 0)


def raw_map(of: Column) -> Column:
    """Every key with its contents in order."""
    keys = F.array_distinct(F.transform(of, lambda m: m.key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(of, lambda m: m.key == k), lambda m: m.content)))


def graph_media(of: Column, kind: str) -> Column:
    """Structured properties, put together in order: a URL begins an asset and the properties after it belong to it.

    Properties without an asset begin an empty one, which only a `:url` can complete.
    """
    prefix = f"og:{kind}"
    zero = F.struct(F.array().cast(f"array<{_MEDIA}>").alias("done"), F.lit(None).cast(_MEDIA).alias("now"))

    def step(acc: Column, m: Column) -> Column:
        now, name, text = acc.now, m.key, m.content
        completes = (name == f"{prefix}:url") & now.isNotNull() & (F.coalesce(now.url, F.lit("")) == "")
        begins = ((name == prefix) | (name == f"{prefix}:url")) & ~F.coalesce(completes, F.lit(False))
        keep = lambda field, part, value: F.when(name == f"{prefix}:{part}", value).otherwise(now[field])
        url = F.when(begins | completes, text).otherwise(F.coalesce(now.url, F.lit("")))
        fresh = lambda c, kind_: F.when(~begins, c).cast(kind_)
        made = F.struct(
            url.alias("url"),
            F.when(begins | completes, m.resolved).otherwise(now.resolved).alias("resolved"),
            fresh(keep("secure", "secure_url", m.resolved), "string").alias("secure"),
            fresh(keep("type", "type", text), "string").alias("type"),
            fresh(keep("width", "width", integer_of(text)), "double").alias("width"),
            fresh(keep("height", "height", integer_of(text)), "double").alias("height"),
            fresh(keep("alt", "alt", text), "string").alias("alt"),
        )
        done = F.when(begins & now.isNotNull(), F.concat(acc.done, F.array(now))).otherwise(acc.done)
        return F.struct(done.alias("done"), made.cast(_MEDIA).alias("now"))

    own = F.filter(of, lambda m: F.startswith(m.key, F.lit(prefix)))
    every = F.aggregate(own, zero, step, lambda acc: F.when(acc.now.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.now))))
    return F.filter(every, lambda a: F.coalesce(a.url, F.lit("")) != "")


def graph_assets(media: Column, kind: str) -> Column:
    return F.transform(media, lambda a: asset(F.coalesce(a.secure, a.resolved), kind, "openGraph", secureUrl=a.secure, type=a.type, width=a.width, height=a.height, alt=a.alt))


#: Keys of card pictures, in the order in which they count.
CARD_KEYS = ("twitter:image", "twitter:image:src", "twitter:images", "twitter:image0", "twitter:image1", "twitter:image2", "twitter:image3", "twitter:player:image")


def card_urls(of: Column) -> Column:
    """(content, resolved) of a card's pictures, each once."""
    take = lambda test: F.transform(F.filter(of, test), lambda m: F.struct(m.content.alias("content"), m.resolved.alias("resolved")))
    is_ = lambda k: lambda m: m.key == k
    listed = [take(is_(k)) for k in CARD_KEYS]
    return F.array_distinct(F.flatten(F.array(*listed, take(lambda m: m.key.rlike(r"(?i)^twitter:image(?::\d+)?$")))))


def card_images(of: Column) -> Column:
    size = {"width": integer_of(first(of, "twitter:image:width")), "height": integer_of(first(of, "twitter:image:height"))}
    return F.transform(card_urls(of), lambda u: asset(u.resolved, "image", "twitter", alt=first(of, "twitter:image:alt"), **size))


def card_videos(of: Column) -> Column:
    """Only players: streams are never read, as an empty list of players isn't a missing one."""
    size = {"width": integer_of(first(of, "twitter:player:width")), "height": integer_of(first(of, "twitter:player:height"))}
    players = F.filter(of, lambda m: m.key == "twitter:player")
    return F.transform(players, lambda m: asset(m.resolved, "video", "twitter", **size))


def meta_named(*names: tuple[str, str]) -> Column:
    """The content of the first of (attribute, value) whose first tag has one."""
    is_ = lambda a, v: lambda m: m[a] == v
    return defined(*[F.get(F.transform(F.filter("metas", is_(a, v)), lambda m: m.content), 0) for a, v in names])


def links_with(*tokens: str) -> Column:
    return F.filter("links", lambda link: F.arrays_overlap(link.rel, F.array(*map(F.lit, tokens))))


def canonical() -> Column:
    return F.try_element_at(F.transform(links_with("canonical"), lambda x: x.href), F.lit(-1))


def image_src() -> Column:
    """The last one, as an array of at most one asset."""
    last = F.try_element_at(links_with("image_src"), F.lit(-1))
    return F.when(last.isNotNull(), F.array(asset(last.resolved, "image", "html"))).otherwise(none())


def favicons() -> Column:
    icons = F.transform(links_with("icon", "shortcut", "apple-touch-icon", "mask-icon"), lambda x: asset(x.resolved, "favicon", "favicon", type=x.type, sizes=x.sizes, rel=x.rel_text))
    return F.filter(icons, lambda a: a.url.isNotNull())


def alternates() -> Column:
    return F.transform(links_with("alternate"), lambda x: F.struct(x.href.alias("href"), x.type.alias("type"), x.hreflang.alias("hreflang"), x.title.alias("title")))


def oembed_links() -> Column:
    """Links to descriptions of the page for embedding, by type, title or a format parameter."""
    fits = lambda x: F.coalesce(x.type.rlike("(?i)oembed"), F.lit(False)) | F.coalesce(x.title.rlike("(?i)oembed"), F.lit(False)) | x.href.rlike("(?i)[?&]format=(?:json|xml)")
    return F.transform(F.filter("links", lambda x: fits(x) & x.resolved.isNotNull()), lambda x: F.struct(x.resolved.alias("href"), x.type.alias("type"), x.title.alias("title")))


def keywords() -> Column:
    text = meta_named(("name", "keywords"))
    return F.filter(F.transform(F.split(text, ","), squashed), lambda k: k.isNotNull())
