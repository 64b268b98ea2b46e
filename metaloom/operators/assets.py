"""Media assets: building, resolving, dropping, merging and the reasons that one is better than another.

An asset is a struct of metaloom.sources.media.ASSET; collections are arrays in order of discovery. Everything is a
Column expression over one row, so no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions.bound import bound
from metaloom.functions.js import rounded, two_places
from metaloom.functions.urls import signature_of
from metaloom.sources.media import _META, ASSET

#: Weight of a source among equal pictures, and base points of a candidate.
RANKS = {"adapter": 90, "openGraph": 80, "twitter": 75, "jsonLd": 70, "oEmbed": 65, "nextData": 64, "nuxt": 62, "initialState": 61, "preloadedState": 60, "apollo": 59, "applicationJson": 58, "jsonScript": 55, "html": 40, "fallback": 30}
POINTS = {"adapter": 98, "openGraph": 94, "oEmbed": 88, "jsonLd": 82, "twitter": 86, "nextData": 76, "nuxt": 74, "initialState": 73, "preloadedState": 73, "apollo": 72, "applicationJson": 70, "jsonScript": 66, "html": 42, "fallback": 36, "favicon": 8}
OTHER = 50
#: Sources that Reddit pages prefer, and what is never their picture.
TRUSTED = ("adapter", "openGraph", "twitter", "jsonLd", "oEmbed", "nextData", "nuxt", "initialState", "preloadedState", "apollo", "applicationJson", "jsonScript")
BAD_REDDIT = r"(?i)thumbs\.redditmedia\.com|avatar|community_icon|subreddit|icon|award|emoji"
#: URLs that discovery drops.
IGNORED = r"(?i)^(?:data|blob|javascript):|(?:sprite|spacer|blank|transparent|placeholder|tracking|beacon|pixel|emoji|favicon|apple-touch-icon)(?:[._/-]|$|\?)|(?:^|[/?_-])1x1(?:[._/-]|$|\?)"
REDDIT_MEDIA = r"(?i)(?:^https?:)?//(?:(?:i|preview|external-preview)\.redd\.it|thumbs\.redditmedia\.com|v\.redd\.it)/"
EMBEDDED = ("nextData", "nuxt", "initialState", "preloadedState", "apollo", "applicationJson", "jsonScript")
SCORED = f"{ASSET[:-1]},score:double,confidence:double,reasons:array<string>>"


def asset(url: Column, kind: str, source: Column | str, **more: Column) -> Column:
    """An asset with the fields of more; the others are null."""
    null = F.lit(None)
    given = {k: more.get(k, null) for k in ("secureUrl", "type", "width", "height", "alt", "title", "poster")}
    meta = F.struct(*[more.get(k, null).cast("string").alias(k) for k in _META])
    fields = [url.cast("string").alias("url"), F.lit(kind).alias("kind"), (source if isinstance(source, Column) else F.lit(source)).alias("source")]
    fields += [v.cast("double" if k in ("width", "height") else "string").alias(k) for k, v in given.items()]
    return F.struct(*fields, meta.alias("metadata"))


def none() -> Column:
    return F.array().cast(f"array<{ASSET}>")


def ignored(url: Column) -> Column:
    return url.rlike(IGNORED)


def usable(assets: Column) -> Column:
    """Drops assets without a URL and those that are never media."""
    return F.filter(assets, lambda a: a.url.isNotNull() & ~ignored(a.url))


def by_source(table: dict[str, int], source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.coalesce(source, F.lit(""))), F.lit(OTHER))


def reddit_priority(a: Column, url: Column | None = None, more: int = 0, otherwise: Column | None = None) -> Column:
    """url is the asset's in lower case, if it is known; more is added to each priority, and otherwise counts where there is none."""
    kind, url = a.metadata.redditMediaKind, F.lower(a.url) if url is None else url
    return (
        F.when(kind == "gallery", 700 + more)
        .when(kind == "previewOriginal", 620 + more)
        .when(kind == "directImage", 580 + more)
        .when(F.contains(url, F.lit("//preview.redd.it/")), 560 + more)
        .when(F.contains(url, F.lit("//i.redd.it/")), 540 + more)
        .when(a.source.isin("openGraph", "twitter"), 420 + more)
        .when(F.contains(url, F.lit("//external-preview.redd.it/")), 300 + more)
        .when(F.contains(url, F.lit("//thumbs.redditmedia.com/")), 1 + more)
        .when(url.rlike(REDDIT_MEDIA), 250 + more)
        .otherwise(F.lit(0) if otherwise is None else otherwise)
    )


def rank(a: Column) -> Column:
    return bound(F.lower(a.url), lambda url: reddit_priority(a, url, 1000, by_source(RANKS, a.source)))


def area(a: Column) -> Column:
    return F.coalesce(a.width, F.lit(0.0)) * F.coalesce(a.height, F.lit(0.0))


def merged(assets: Column) -> Column:
    """One asset for each signature, at the place of its first, with the highest rank (the first of equal ones)."""

    def chosen(keyed: Column) -> Column:
        best = lambda s: F.array_max(F.transform(F.filter(keyed, lambda k: k.sig == s), lambda k: F.struct(k.rank, k["at"], k.a)))
        return F.transform(F.array_distinct(F.transform(keyed, lambda k: k.sig)), lambda s: best(s).a)

    keyed = lambda of: F.transform(of, lambda a, i: F.struct(signature_of(a.url).alias("sig"), rank(a).alias("rank"), (-i).alias("at"), a.alias("a")))
    return bound(assets, lambda of: F.when(F.size(of) <= 1, of).otherwise(bound(keyed(of), chosen)))


def unique_by_url(assets: Column) -> Column:
    first = lambda of, urls: F.filter(of, lambda a, i: F.array_position(urls, a.url) == i + 1)
    return bound(assets, lambda of: F.when(F.size(of) == 0, of).otherwise(bound(F.transform(of, lambda a: a.url), lambda urls: first(of, urls))))


def reddit_filtered(assets: Column) -> Column:
    """On Reddit: large enough pictures that aren't decoration, only trusted ones if there are any, best first."""
    big = lambda side: F.coalesce(side >= 200, F.lit(True))
    allowed = F.filter(assets, lambda a: big(a.width) & big(a.height) & ~a.url.rlike(BAD_REDDIT))
    trusted = F.filter(allowed, lambda a: a.source.isin(*TRUSTED) | a.metadata.redditMediaKind.isNotNull())
    chosen = F.when(F.size(trusted) > 0, trusted).otherwise(allowed)
    keyed = F.transform(chosen, lambda a, i: F.struct((-reddit_priority(a)).alias("p"), (-area(a)).alias("s"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k.a)


def discovered(images: Column, videos: Column, audio: Column, reddit: Column) -> dict[str, Column]:
    """The media of a page from all candidates in order of their sources; reddit says whether it is a page of Reddit."""
    pictures = merged(usable(images))
    return {
        "images": F.when(reddit, reddit_filtered(pictures)).otherwise(pictures),
        "videos": merged(unique_by_url(usable(videos))),
        "audio": merged(unique_by_url(usable(audio))),
    }


def _shown(n: Column) -> Column:
    return F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def _dimensions(a: Column) -> tuple[Column, list[Column]]:
    w, h = a.width, a.height
    known = (F.coalesce(w, F.lit(0.0)) != 0) & (F.coalesce(h, F.lit(0.0)) != 0)
    ratio, size, both = F.try_divide(w, h), w * h, F.concat(_shown(w), F.lit("x"), _shown(h))
    near = lambda t, d: F.abs(ratio - t) <= d
    low, text = (w < 120) | (h < 90), F.format_string("%.2f", ratio)
    by_area = F.when(low, -35).when(size >= 1_000_000, 12).when(size >= 300_000, 9).when(size >= 90_000, 5).when(size < 10_000, -20).otherwise(0)
    by_ratio = F.when(near(1.91, 0.18), 12).when(near(16 / 9, 0.2) | near(1.0, 0.2), 8).when((ratio > 4) | (ratio < 0.25), -16).otherwise(0)
    said = [
        F.when(~known, "dimensions are unknown")
        .when(low, F.concat(both, F.lit(" is below preview minimum and subtracted 35 points")))
        .when(by_area > 0, F.concat(both, F.lit(" dimensions added "), by_area.cast("string"), F.lit(" points")))
        .when(by_area < 0, F.concat(both, F.lit(" dimensions subtracted 20 points"))),
        F.when(known & (by_ratio != 0), F.concat(F.lit("aspect ratio "), text, F.when(by_ratio == 12, " matched social preview ratio").when(by_ratio == 8, " matched a common preview ratio").otherwise(" is unlikely to preview well"))),
    ]
    return F.when(known, by_area + by_ratio).otherwise(0), said


def _format(a: Column, url: Column) -> tuple[Column, list[Column]]:
    kind = F.lower(F.coalesce(a.type, F.lit("")))
    has = lambda *words: F.lit(False) if not words else kind.rlike("|".join(words))
    webp, avif = has("webp") | F.endswith(url, F.lit(".webp")), has("avif") | url.rlike(r"\.avif(\?|$)")
    jpeg, png, weak = has("jpeg", "jpg") | url.rlike(r"\.jpe?g(\?|$)"), has("png") | url.rlike(r"\.png(\?|$)"), url.rlike(r"\.(gif|svg|ico)(\?|$)")
    points = F.when(webp | avif, 4).when(jpeg, 3).when(png, 2).when(weak, -8).otherwise(0)
    said = F.when(webp, "modern WebP format added 4 points").when(avif, "modern AVIF format added 4 points").when(jpeg, "JPEG format added 3 points").when(png, "PNG format added 2 points").when(weak, "GIF/SVG/ICO formats are weaker preview candidates")
    return points, [said]


def _hinted(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(url, F.lit("cover|preview|thumbnail|thumb|og|card|media|hero|share|social|maxres|highres|large|original"), F.lit(0)))


def _hints(url: Column, found: Column) -> tuple[Column, list[Column]]:
    points = F.least(F.size(found) * 4, F.lit(14))
    video, reddit = url.rlike(r"ytimg\.com/vi/[^/]+/(?:maxresdefault|sddefault|hqdefault)"), url.rlike(r"(?:i|preview|external-preview)\.redd\.it|v\.redd\.it")
    social = url.rlike(r"pbs\.twimg\.com/media|pinimg\.com|cdninstagram\.com|fbcdn\.net|tiktokcdn\.com|mir-s3-cdn-cf\.behance\.net")
    host = F.when(video, 12).when(reddit, 10).when(social, 8).otherwise(0)
    said = [
        F.when(F.size(found) > 0, F.concat(F.lit("URL matched preview hints ("), F.array_join(found, ", "), F.lit(") and added "), points.cast("string"), F.lit(" points"))),
        F.when(video, "YouTube platform thumbnail added 12 points").when(reddit, "Reddit media host added 10 points").when(social, "social platform media host added 8 points"),
    ]
    return points + host, said


def _reddit(a: Column, url: Column) -> tuple[Column, list[Column]]:
    kind = a.metadata.redditMediaKind
    at = lambda host: F.contains(url, F.lit(f"//{host}/"))
    rules = [
        (kind == "gallery", 24, "Reddit gallery media added 24 points"),
        (kind == "previewOriginal", 20, "Reddit original preview media added 20 points"),
        (at("i.redd.it"), 18, "Reddit direct image media added 18 points"),
        (at("preview.redd.it"), 16, "Reddit preview media added 16 points"),
        (at("external-preview.redd.it"), -8, "Reddit external preview media subtracted 8 points"),
        (at("thumbs.redditmedia.com"), -60, "Reddit thumbnail host subtracted 60 points"),
    ]
    points, said = F.lit(0), F.lit(None).cast("string")
    for test, n, text in reversed(rules):
        points, said = F.when(test, n).otherwise(points), F.when(test, text).otherwise(said)
    return points, [said]


def url_penalty(a: Column, url: Column) -> Column:
    return (
        F.when(url.rlike("favicon|apple-touch-icon|sprite|icon-|/icon|placeholder|blank|spacer|pixel|tracking|emoji"), 30).otherwise(0)
        + F.when(url.rlike("logo|avatar|profile|headshot|badge"), 22).otherwise(0)
        + F.when(a.alt.rlike("(?i)logo|avatar|icon|emoji"), 14).otherwise(0)
        + F.when(a.kind == "favicon", 35).otherwise(0)
    )


def label(a: Column) -> Column:
    """The source of an asset, for adapters with the source that they took it from."""
    adapter = F.coalesce(a.metadata.adapter, F.lit("adapter"))
    return F.when(a.source == "adapter", F.when(a.metadata.originalSource.isNotNull(), F.concat(adapter, F.lit(" ("), a.metadata.originalSource, F.lit(")"))).otherwise(adapter)).otherwise(a.source)


def named(source: Column) -> Column:
    """A source as reasons name it."""
    names = {"openGraph": "og:image", "twitter": "Twitter Card metadata", "jsonLd": "JSON-LD"} | dict.fromkeys(EMBEDDED, "embedded application data")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), source), source)


def read_url(a: Column, url: Column) -> Column:
    """What several parts of a score ask of an asset's URL (url is it in lower case)."""
    return F.struct(url.alias("url"), _hinted(url).alias("hints"), url_penalty(a, url).alias("penalty"), by_source(POINTS, a.source).alias("base"))


def points(a: Column, index: Column, count: Column, same: Column, read: Column) -> tuple[Column, list[Column]]:
    """The score of one candidate among count before custom scorers and limits, and the reasons (null where one doesn't apply).

    same is the number of candidates with its signature, read what read_url() says.
    """
    base, url = read.base, read.url
    parts = [_dimensions(a), _format(a, url), _hints(url, read.hints), _reddit(a, url)]
    twice = F.when(same > 1, F.least((same - 1) * 4, F.lit(12))).otherwise(0)
    place, penalty = F.least(index * 1.5, F.lit(10.0)), read.penalty
    score = base + sum((p for p, _ in parts), F.lit(0)) - penalty - twice - place + F.when(count == 1, 4).otherwise(0)
    said = [F.concat(F.lit("source "), named(a.source), F.lit(" added "), base.cast("string"), F.lit(" base points")), *(s for _, more in parts for s in more)]
    said += [
        F.when(twice > 0, F.concat(F.lit("duplicate-like URL group subtracted "), twice.cast("string"), F.lit(" points"))),
        F.when(count == 1, "only candidate image added 4 points"),
        F.when(penalty > 0, F.concat(F.lit("URL penalties subtracted "), penalty.cast("string"), F.lit(" points"))),
        F.when(place > 0, F.concat(F.lit("candidate position subtracted "), F.when(place == F.floor(place), place.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", place)), F.lit(" points"))),
    ]
    return score.cast("double"), said


def scored(images: Column, scorers: tuple = ()) -> Column:
    """Images with score, confidence and reasons, best first.

    scorers are functions (asset, index, images) -> Column of points that are added.
    """
    context = F.exists(images, lambda a: (a.metadata.adapter == "redditAdapter") | (a.metadata.originalSource == "redditJsonEndpoint") | a.metadata.redditMediaKind.isNotNull())

    def one(a: Column, i: Column, alike: Column, read: Column) -> Column:
        score, said = points(a, i, F.size(images), F.get(alike, i), read)
        extra = sum((s(a, i, images) for s in scorers), F.lit(0.0)) if scorers else F.lit(0.0)
        total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score + extra))
        sign = F.when(extra >= 0, "+").otherwise("")
        said = [*said, F.when(extra != 0, F.concat(F.lit("custom scorers adjusted score by "), sign, _shown(extra)))] if scorers else said
        reasons = F.filter(F.array(*said), lambda x: x.isNotNull())
        return F.struct(a.alias("a"), total.alias("score"), reasons.alias("reasons"), i.alias("i"))

    def key(x: Column, reddit: Column) -> Column:
        first = F.when(F.coalesce(reddit, F.lit(False)), -reddit_priority(x.a)).otherwise(0)
        fields = [x.a[f].alias(f) for f in ("url", "kind", "source", "secureUrl", "type", "width", "height", "alt", "title", "poster", "metadata")]
        made = F.struct(*fields, x.score.alias("score"), two_places(x.score).alias("confidence"), x.reasons.alias("reasons"))
        return F.struct(first.alias("p"), (-x.score).alias("s"), (-by_source(POINTS, x.a.source)).alias("w"), (-area(x.a)).alias("z"), x.i.alias("i"), made.alias("a"))

    count = lambda signatures: F.transform(signatures, lambda s: F.size(F.filter(signatures, lambda t: t == s)))
    alike = F.when(F.size(images) == 1, F.array(F.lit(1))).otherwise(bound(F.transform(images, lambda a: signature_of(a.url)), count))
    each = lambda a, i, n: bound(bound(F.lower(a.url), lambda url: read_url(a, url)), lambda read: one(a, i, n, read))
    made = bound(alike, lambda n: F.transform(images, lambda a, i: each(a, i, n)))
    sorted_ = bound(context, lambda reddit: F.array_sort(F.transform(made, lambda x: key(x, reddit))))
    return F.when(F.size(images) == 0, F.array().cast(f"array<{SCORED}>")).otherwise(F.transform(sorted_, lambda k: k.a))


def scored_rows(rows: DataFrame, page: str) -> DataFrame:
    """The same for a table of candidates (page, at from 0, a): adds score, reasons, alike (candidates of its signature) and ord from 0, with windows instead of arrays."""
    own, same = Window.partitionBy(page), Window.partitionBy(page, "_sig")
    rows = rows.withColumn("_sig", signature_of(F.col("a.url"))).withColumns({"_n": F.count(F.lit(1)).over(own), "alike": F.count(F.lit(1)).over(same)})
    a = F.col("a")
    rows = rows.withColumn("_read", read_url(a, F.lower(a.url)))
    score, said = points(a, F.col("at"), F.col("_n"), F.col("alike"), F.col("_read"))
    context = (a.metadata.adapter == "redditAdapter") | (a.metadata.originalSource == "redditJsonEndpoint") | a.metadata.redditMediaKind.isNotNull()
    rows = rows.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), "reasons": F.array_remove(F.array(*[F.coalesce(x, F.lit("")) for x in said]), ""), "_reddit": F.max(F.coalesce(context, F.lit(False))).over(own)})
    first = F.when(F.col("_reddit"), reddit_priority(a)).otherwise(0)
    order = own.orderBy(first.desc(), F.col("score").desc(), by_source(POINTS, a.source).desc(), area(a).desc(), "at")
    return rows.withColumn("ord", F.row_number().over(order) - 1).drop("_sig", "_n", "_reddit", "_read")


def choice(best: Column) -> Column:
    """Why an image was chosen."""
    known = (F.coalesce(best.width, F.lit(0.0)) != 0) & (F.coalesce(best.height, F.lit(0.0)) != 0)
    size = F.when(known, F.concat(_shown(best.width), F.lit("x"), _shown(best.height))).otherwise("unknown dimensions")
    reasons = F.array_join(F.slice(best.reasons, 1, 4), "; ")
    return F.when(best.isNotNull(), F.concat(F.lit("Selected because it came from "), named(best.source), F.lit(", has "), size, F.lit(", and scored "), rounded(best.score).cast("string"), F.lit("."), F.when(reasons != "", F.concat(F.lit(" Reasons: "), reasons, F.lit("."))).otherwise("")))
