"""Media candidates in markup and in JSON, with resolved URLs, in the order in which they are considered."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from metaloom.functions.js import squash, to_integer
from metaloom.functions.urls import resolve
from metaloom.sources.html import Element, elements
from metaloom.sources.payload import LONGEST_KEY, number_in, place_of, walk

METADATA = "adapter string, originalSource string, redditMediaKind string, tiktokMediaKind string, discoveredFrom string, embeddedPath string, sizes string, rel string"
ASSET = "struct<url:string,kind:string,source:string,secureUrl:string,type:string,width:double,height:double,alt:string,title:string,poster:string,metadata:struct<" + ",".join(x.replace(" ", ":") for x in METADATA.split(", ")) + ">>"
_FIELDS = ("url", "kind", "source", "secureUrl", "type", "width", "height", "alt", "title", "poster")
_META = tuple(x.split()[0] for x in METADATA.split(", "))

#: Attributes that hold pictures, sets of pictures and media until a script loads them.
LAZY = ("data-src", "data-original", "data-lazy-src", "data-image", "data-image-url", "data-og-image", "data-thumbnail", "data-thumb", "data-media", "data-full-src", "data-hi-res-src", "data-zoom-src", "data-poster", "data-bg")
LAZY_SETS = ("data-srcset", "data-lazy-srcset", "data-original-srcset")
LAZY_MEDIA = ("data-src", "data-original", "data-lazy-src", "data-video", "data-video-url", "data-media", "data-playback-url")
#: JSON keys that hold media, by kind.
KEYS = {
    "image": ["image", "images", "thumbnail", "thumbnailurl", "thumbnail_url", "thumbnailsrc", "thumbnail_src", "previewimage", "preview_image", "preview", "ogimage", "og_image", "cardimage", "displayurl", "display_url", "mediaurl", "media_url", "media_url_https", "fullpicture", "full_picture", "cover", "coverimage", "cover_image", "original", "source", "poster", "posterimage", "media"],
    "video": ["video", "videos", "videourl", "video_url", "contenturl", "content_url", "embedurl", "embed_url", "playbackurl", "playback_url", "fallback_url", "hls_url", "dash_url", "media"],
    "audio": ["audio", "audios", "audiourl", "audio_url", "podcasturl"],
}
#: Fields of a record that may hold its URL, and those that come first for video; fields that may hold a nested one.
PLACES = ["url", "src", "secure_url", "secureUrl", "contentUrl", "content_url", "embedUrl", "embed_url", "thumbnailUrl", "thumbnail_url", "thumbnailSrc", "thumbnail_src", "mediaUrl", "media_url", "media_url_https", "displayUrl", "display_url", "fullPicture", "full_picture", "previewImage", "preview_image", "poster", "posterUrl", "poster_url", "coverImage", "cover_image", "original", "source"]
VIDEO_PLACES = ["videoUrl", "video_url", "playbackUrl", "playback_url", "fallback_url", "hls_url", "dash_url"]
NESTED = ["source", "original", "image", "thumbnail", "thumbnailUrl", "thumbnail_url", "previewImage", "preview_image", "video", "reddit_video"]
LINKED = {"image": ("image", "thumbnailUrl", "thumbnail", "logo"), "video": ("contentUrl", "embedUrl", "video"), "audio": ("contentUrl", "encoding")}
#: URLs of markup that are never media, those that discovery drops as well, and hints of each kind.
_DATA = re.compile(r"(?:data|blob|javascript):", re.I)
_NOT_MARKUP = re.compile(r"(?:sprite|spacer|blank|transparent|placeholder|tracking|beacon|pixel)(?:[._/-]|$|\?)|(?:^|[/?_-])1x1(?:[._/-]|$|\?)", re.I)
_NOT_MEDIA = re.compile(r"(?:sprite|spacer|blank|transparent|placeholder|tracking|beacon|pixel|emoji|favicon|apple-touch-icon)(?:[._/-]|$|\?)|(?:^|[/?_-])1x1(?:[._/-]|$|\?)", re.I)
#: Words of which one is in whatever the two find; looking for them first is cheaper.
_WORDS = ("sprite", "spacer", "blank", "transparent", "placeholder", "tracking", "beacon", "pixel", "1x1", "emoji", "favicon", "apple-touch-icon")
_SMALL_ICON = re.compile("icon|favicon|apple-touch-icon|sprite|logo|avatar", re.I)
_EMBEDS = re.compile(r"youtube\.com|youtu\.be|vimeo\.com|dailymotion\.com|tiktok\.com|instagram\.com|facebook\.com|player\.", re.I)
_PLACE = re.compile(r"https?://|/|\./|\.\./", re.I)
_HINTS = {
    "image": re.compile(r"\.(?:avif|webp|png|jpe?g|gif)(?:[?#].*)?$|image|thumb|thumbnail|cover|poster|preview|media|og|card|photo|format=(?:jpg|jpeg|png|webp)|ytimg\.com|i\.redd\.it|preview\.redd\.it|external-preview\.redd\.it|pbs\.twimg\.com|pinimg\.com|cdninstagram\.com|fbcdn\.net|tiktokcdn\.com|behance\.net", re.I),
    "video": re.compile(r"\.(?:mp4|webm|m3u8|mov)(?:[?#].*)?$|video|embed|player|watch|reel|shorts|v\.redd\.it", re.I),
    "audio": re.compile(r"\.(?:mp3|m4a|wav|ogg|aac)(?:[?#].*)?$|audio|podcast", re.I),
}


_BLANK, _NO_META, _SIZES = dict.fromkeys((*_FIELDS, "metadata")), dict.fromkeys(_META), ("width", "height")


def _finds(pattern: re.Pattern, url: str) -> bool:
    """Whether _NOT_MARKUP or _NOT_MEDIA finds something."""
    low = url.lower()
    return (not url.isascii() or any(w in low for w in _WORDS)) and bool(pattern.search(url))


def asset(url: str, kind: str, source: str, **more) -> dict:
    a, meta = _BLANK.copy(), _NO_META.copy()
    a["url"], a["kind"], a["source"], a["metadata"] = url, kind, source, meta
    for k, v in more.items():
        if k in _NO_META:
            meta[k] = v
        elif v is not None:
            a[k] = float(v) if k in _SIZES else v
    return a


def srcset(value: str | None) -> list[str]:
    """The first word of each part between commas."""
    return [w[0] for w in (part.split() for part in value.split(",")) if w] if value else []


def _unique(assets: list[dict]) -> list[dict]:
    seen: dict[str, dict] = {}
    for a in assets:
        seen.setdefault(a["url"], a)
    return list(seen.values())


def markup(found: list[Element], base: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Pictures, videos and sounds of a page's elements."""
    images: list[dict] = []
    videos: list[dict] = []
    sounds: list[dict] = []
    owned: dict[int, list[Element]] = {}
    for e in found:
        if e.tag == "source" and e.owner and e.get("src") is not None:
            owned.setdefault(id(e.owner), []).append(e)

    def put(into: list[dict], url: str | None, kind: str, source: str = "html", **more) -> None:
        url = resolve(squash(url), base) if url else None
        if not url or _DATA.match(url) or _finds(_NOT_MARKUP, url):
            return
        w, h = more.get("width"), more.get("height")
        if kind == "image" and w is not None and h is not None and (w <= 2 or h <= 2 or (w <= 64 and h <= 64 and _SMALL_ICON.search(url))):
            return
        into.append(asset(url, kind, source, **more))

    def pictures(of: list[Element], source: str) -> None:
        for e in of:
            if e.tag == "img":
                get = e.attributes.get
                same = {"width": to_integer(get("width")), "height": to_integer(get("height")), "alt": squash(get("alt")), "title": squash(get("title")), "discoveredFrom": "noscript" if source == "fallback" else "img"}
                late = any(k.startswith("data-") for k in e.attributes)
                places = [get("src"), *(map(get, LAZY) if late else ()), *srcset(get("srcset")), *(u for k in (LAZY_SETS if late else ()) for u in srcset(get(k)))]
                for url in filter(None, places):
                    put(images, url, "image", source, **same)
        for e in of:
            if e.tag == "source" and e.get("srcset") is not None and (e.inside == "picture" or (e.get("type") or "").startswith("image/")):
                for url in [*srcset(e.get("srcset")), *(u for k in LAZY_SETS for u in srcset(e.get(k)))]:
                    put(images, url, "image", source, type=squash(e.get("type")), discoveredFrom="noscript.picture.source" if source == "fallback" else "picture.source")

    links = [e for e in found if e.tag == "link" and e.get("href") is not None and e.get("rel") is not None]
    for e in links:
        if e.get("rel") == "image_src":
            put(images, e.get("href"), "image")
    loads = [(e, (squash(e.get("as")) or "").lower(), squash(e.get("type"))) for e in links if {"preload", "prefetch"} & set((squash(e.get("rel")) or "").lower().split())]
    for e, as_, type_ in loads:
        if as_ == "image" or (type_ or "").startswith("image/"):
            put(images, e.get("href"), "image", type=type_, discoveredFrom="link.preload")
            for url in srcset(e.get("imagesrcset")):
                put(images, url, "image", type=type_, discoveredFrom="link.imagesrcset")
    pictures(found, "html")
    for e in found:
        if e.tag == "video" and e.get("poster") is not None:
            put(images, e.get("poster"), "image", width=to_integer(e.get("width")), height=to_integer(e.get("height")), discoveredFrom="video.poster")
    for e in found:
        if e.tag == "noscript" and e.text:
            pictures(elements(e.text), "fallback")
    for e in found:
        if e.tag == "video" and (e.attributes or id(e) in owned):  # one without either has no media
            same = {"width": to_integer(e.get("width")), "height": to_integer(e.get("height")), "poster": resolve(squash(e.get("poster")), base)}
            lazy = [squash(e.get(k)) for k in LAZY_MEDIA]
            for url in [squash(e.get("src")) or next(filter(None, lazy), None), *lazy]:
                put(videos, url, "video", **same)
            for s in owned.get(id(e), ()):
                put(videos, s.get("src"), "video", type=squash(s.get("type")), **same)
    for e in found:
        if e.tag == "iframe" and (src := squash(e.get("src"))) and _EMBEDS.search(src):
            put(videos, src, "video", width=to_integer(e.get("width")), height=to_integer(e.get("height")))
    for e, as_, type_ in loads:
        if as_ == "video" or (type_ or "").startswith("video/"):
            put(videos, e.get("href"), "video", type=type_, discoveredFrom="link.preload")
    for e in found:
        if e.tag == "audio" and (e.attributes or id(e) in owned):
            put(sounds, e.get("src"), "audio")
            for s in owned.get(id(e), ()):
                put(sounds, s.get("src"), "audio", type=squash(s.get("type")))
    return _unique(images), _unique(videos), _unique(sounds)


def looks_like(url: str, kind: str) -> bool:
    return bool(_PLACE.match(url) and not _DATA.match(url) and not _finds(_NOT_MEDIA, url) and _HINTS[kind].search(url))


def _place_in(record: dict, kind: str) -> str | None:
    for k in (*VIDEO_PLACES, *PLACES) if kind == "video" else PLACES:
        if k in record and (url := place_of(record[k])) and looks_like(url, kind):
            return url
    return None


def in_value(value, kind: str, source: str) -> Iterator[dict]:
    """Media of a JSON value that stands where media are expected."""
    if isinstance(value, str):
        if looks_like(value, kind):
            yield asset(value, kind, source)
    elif isinstance(value, list):
        for v in value:
            yield from in_value(v, kind, source)
    elif isinstance(value, dict):
        if url := _place_in(value, kind):
            inner = next((v for v in map(value.get, NESTED) if isinstance(v, dict) and _place_in(v, kind)), {})
            first = lambda *vs: next(filter(None, map(place_of, vs)), None)
            size = lambda k: n if (n := number_in(value.get(k))) is not None else number_in(inner.get(k))
            yield asset(
                url, kind, source, width=size("width"), height=size("height"),
                alt=first(value.get("alt"), value.get("caption"), value.get("name"), inner.get("alt")),
                title=first(value.get("title"), inner.get("title")),
                type=first(value.get("type"), value.get("mimeType"), value.get("encodingFormat"), inner.get("type")),
            )
        for url in srcset(place_of(value.get("srcset")) or place_of(value.get("srcSet"))):
            yield from in_value(url, kind, source)


def _told(key: str) -> tuple[tuple[str, bool], ...]:
    """The kinds of media that a key names, and whether it is one of their keys or only contains one."""
    low = key.lower()
    return tuple((kind, low in keys) for kind, keys in KEYS.items() if any(k in low for k in keys))


_told_once = lru_cache(maxsize=1 << 12)(_told)


def in_payload(nodes: list[dict], items: list[tuple[str, str | None, dict]], kinds: Iterable[str], base: str) -> dict[str, list[dict]]:
    """Media of linked data, then of application data, by kind, from one walk."""
    found = {kind: [a for node in nodes for k in LINKED[kind] for a in in_value(node.get(k), kind, "jsonLd")] for kind in kinds}
    for source, path, data in items:
        for value, key, parent in walk(data):
            if not key:
                continue
            for kind, named in _told_once(key) if len(key) <= LONGEST_KEY else _told(key):
                if kind not in found:
                    continue
                if named:
                    found[kind] += in_value(value, kind, source)
                elif isinstance(value, str) and looks_like(value, kind):
                    p = parent or {}
                    found[kind].append(asset(value, kind, source, width=number_in(p.get("width")), height=number_in(p.get("height")), alt=place_of(p.get("alt")) or place_of(p.get("caption")), title=place_of(p.get("title")), embeddedPath=path))
    for assets in found.values():
        for a in assets:
            a["url"] = resolve(a["url"], base)
    return {kind: [a for a in assets if a["url"]] for kind, assets in found.items()}

