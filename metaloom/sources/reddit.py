"""What a Reddit listing says of its post, and the page that stands for it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html import escape
from math import isfinite
from urllib.parse import urlsplit

from metaloom.functions.js import squash, to_number
from metaloom.sources.payload import compact, parse, scalar

MOST_CHILDREN, LEAST_SIDE = 100, 200
#: What is never a post's picture, and how much a kind of picture, else its host, counts.
BAD = re.compile(r"thumbs\.redditmedia\.com|avatar|community_icon|subreddit|icon|award|emoji", re.I)
KINDS = {"gallery": 700, "previewOriginal": 620, "directImage": 580}
PLACES = (("//preview.redd.it/", 560), ("//i.redd.it/", 540), ("//external-preview.redd.it/", 300), ("//v.redd.it/", 250))


def post_of(value) -> dict | None:
    """The first record that is a post."""
    if isinstance(value, list):
        return next((p for p in map(post_of, value) if p), None)
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("title"), str) and (isinstance(value.get("id"), str) or isinstance(value.get("name"), str)):
        return value
    for child in _list(_dict(value.get("data")).get("children")):
        inner = _dict(_dict(child).get("data"))
        if inner and (child.get("kind") == "t3" or isinstance(inner.get("title"), str)):
            return inner
    return next((p for p in map(post_of, list(value.values())[:MOST_CHILDREN]) if p), None)


def _dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value) -> list:
    return value if isinstance(value, list) else []


def _first(record: dict, *keys: str) -> str | None:
    return next(filter(None, (scalar(record.get(k)) for k in keys)), None)


def _number(record: dict, *keys: str) -> float | None:
    for k in keys:
        v = record.get(k)
        n = to_number(v) if isinstance(v, str) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        if n is not None and isfinite(n):
            return n
    return None


def _place(record: dict, *keys: str) -> str | None:
    url = _first(record, *keys)
    return url and url.replace("&amp;", "&")


def _made(url: str | None, size: dict, kind: str, type_: str | None = None) -> Iterator[tuple[str, dict]]:
    if url:
        yield kind, {"url": url, "width": _number(size, "x", "width"), "height": _number(size, "y", "height"), "type": type_}


def _found(post: dict) -> Iterator[tuple[str, dict]]:
    """(kind, picture): the gallery in its order, the direct one, previews (the original, else the largest), the thumbnail."""
    meta, previews = _dict(post.get("media_metadata")), [i for i in _list(_dict(post.get("preview")).get("images")) if isinstance(i, dict)]
    order = filter(None, (scalar(_dict(i).get("media_id")) for i in _list(_dict(post.get("gallery_data")).get("items"))))
    for record in map(_dict, (meta.get(k) for k in dict.fromkeys([*order, *meta]))):
        original = _dict(record.get("s"))
        yield from _made(_place(original, "u", "gif", "mp4"), original, "gallery", scalar(record.get("m")))
    direct = _place(post, "url_overridden_by_dest", "url")
    if direct and _host(direct) in ("i.redd.it", "preview.redd.it"):
        yield from _made(direct, _dict(previews[0].get("source")) if previews else {}, "directImage")
    for image in previews:
        original = _dict(image.get("source"))
        if not _first(original, "url", "u"):
            sizes = [r for r in _list(image.get("resolutions")) if isinstance(r, dict)]
            original = max(sizes, key=lambda r: (_number(r, "width") or 0) * (_number(r, "height") or 0), default={})
        yield from _made(_place(original, "url", "u"), original, "previewOriginal" if original is image.get("source") else "previewResolution")
    thumbnail = _place(post, "thumbnail")
    if thumbnail and re.match("https?://", thumbnail, re.I):
        yield from _made(thumbnail, {}, "thumbnail")


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def pictures(post: dict) -> list[dict]:
    """A post's pictures, each once, those that count most first; none that is small or decoration."""

    def weight(kind: str, picture: dict) -> tuple[float, float]:
        by_place = next((n for part, n in PLACES if part in picture["url"].lower()), 0)
        return -KINDS.get(kind, by_place), -(picture["width"] or 0) * (picture["height"] or 0)

    large = [(k, p) for k, p in _found(post) if not BAD.search(p["url"]) and all(p[side] is None or p[side] >= LEAST_SIDE for side in ("width", "height"))]
    unique: dict[str, dict] = {}
    for _, p in sorted(large, key=lambda x: weight(*x)):
        unique.setdefault(p["url"], p)
    return list(unique.values())


def videos(post: dict) -> list[dict]:
    records = [_dict(_dict(post.get(k)).get("reddit_video")) for k in ("media", "secure_media")]
    return [{"url": url, "width": _number(r, "width"), "height": _number(r, "height")} for r in records if (url := _place(r, "fallback_url", "hls_url", "dash_url"))]


def _stripped(value):
    """Without nulls and empty lists."""
    if isinstance(value, list):
        return [_stripped(v) for v in value if v is not None]
    if isinstance(value, dict):
        return {k: _stripped(v) for k, v in value.items() if v is not None and v != []}
    return value


def page_of(body: str | None) -> str | None:
    """The page that stands for a listing: the post as tags, linked data and application data; None if there is no post in it."""
    try:
        post = post_of(parse(body or ""))
    except (ValueError, RecursionError):
        return None
    if not post:
        return None
    title, link, made = _first(post, "title"), _first(post, "permalink"), _number(post, "created_utc")
    text = next(filter(None, (squash(_first(post, k)) for k in ("selftext", "selftext_html", "url_overridden_by_dest"))), None)
    url = link and "https://www.reddit.com" + (link if link.startswith("/") else f"/{link}")
    when = datetime.fromtimestamp(made, UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") if made and 0 < made < 253_402_300_800 else None
    author, images, films = _first(post, "author", "author_fullname"), pictures(post), videos(post)
    best, film = images[0] if images else None, films[0] if films else None
    # The keys that the readers of linked data and application data know.
    linked = {
        "@context": "https://schema.org", "@type": "SocialMediaPosting", "headline": title, "description": text, "author": author and {"@type": "Person", "name": author}, "datePublished": when, "url": url,
        "image": best and {"@type": "ImageObject", **{k: best[k] for k in ("url", "width", "height")}}, "video": film and {"@type": "VideoObject", "contentUrl": film["url"], "width": film["width"], "height": film["height"]},
    }
    state = {
        "postTitle": title, "description": text, "author": author and {"name": author}, "createdAt": when, "canonicalUrl": url, "previewImage": best, "media": film and {"videoUrl": film["url"]},
        "images": images, "videos": films, "subreddit": _first(post, "subreddit_name_prefixed", "subreddit"), "postId": _first(post, "id"),
    }
    tags = {"og:title": title, "og:description": text, "og:site_name": "Reddit", "og:url": url, "og:image": best and best["url"], "og:image:width": best and scalar(best["width"]), "og:image:height": best and scalar(best["height"])}
    head = [f"<title>{escape(title or 'Reddit post')}</title>", *(f'<meta property="{k}" content="{escape(v)}">' for k, v in tags.items() if v)]
    head += [f'<link rel="canonical" href="{escape(url)}">'] if url else []
    script = lambda kind, data: f"<script {kind}>{compact(_stripped(data)).replace('<', chr(92) + 'u003c')}</script>"
    return "".join([*head, script('type="application/ld+json"', linked), script('type="application/json" id="reddit-json"', {"post": state})])
