"""Facts that the adapters of known sites need from a page's JSON, read only on those sites' pages."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from functools import lru_cache
from urllib.parse import urlsplit

from metaloom.functions.js import squash
from metaloom.functions.urls import resolve
from metaloom.sources.media import ASSET, asset
from metaloom.sources.payload import joined, types_of, walk

PERSON = "struct<name:string,url:string,logo:string>"
SITE = (
    f"struct<person:{PERSON},published:string,tags:array<string>,views:bigint,ld_video_title:string,ld_video_description:string,ld_post_title:string,ld_post_description:string,"
    "player_title:string,player_description:string,initial_title:string,initial_description:string,playlist_title:string,playlist:array<struct<id:string,title:string,url:string>>,reddit_payload:boolean,"
    f"item_text:string,item_music:string,item_person:{PERSON},item_published:string,item_duration:string,item_plays:bigint,item_images:array<{ASSET}>,item_videos:array<{ASSET}>>"
)
#: Hosts of the known sites, and the keys under which each keeps the author.
HOSTS = {
    "youtube": ("youtube.com", "youtu.be", "youtube-nocookie.com"),
    "reddit": ("reddit.com", "redd.it"),
    "pinterest": ("pinterest.com", "pin.it"),
    "behance": ("behance.net",),
    "tiktok": ("tiktok.com",),
    "facebook": ("facebook.com", "fb.watch"),
    "twitter": ("twitter.com", "x.com", "t.co"),
    "instagram": ("instagram.com",),
}
PEOPLE = {
    "youtube": ("author", "ownerchannelname", "channel", "owner"),
    "reddit": ("author", "submitter", "user"),
    "pinterest": ("pinner", "author", "creator", "owner", "user"),
    "behance": ("owners", "author", "creator", "user"),
    "tiktok": ("author",),
    "facebook": ("author", "owner", "profile", "user"),
    "twitter": ("author", "user", "screen_name", "creator"),
    "instagram": ("owner", "author", "user", "username"),
}
MOST_VIDEOS = 100
_AUTHORITY = re.compile(r"[a-z]+://(?:[^/?#]*@)?([^/?#:]*)")
_POSTS = ("socialmediaposting", "discussionforumposting", "article")
_LOW_QUALITY = re.compile(r"\{[^}]+\}|tiktok\s*shop|free shipping|eligible items|exclusive collections|^tiktok live creator networks$|^tiktok\s*-\s*make your day$|^discover (?:new |popular )?videos?\b.*\btiktok\b", re.I)


def site_of(url: str) -> str | None:
    """The known site of an absolute URL's host."""
    m = _AUTHORITY.match(url)
    return _site(m[1].lower().removeprefix("www.")) if m else None


@lru_cache(maxsize=1 << 12)
def _site(host: str) -> str | None:
    return next((s for s, domains in HOSTS.items() if any(host == d or host.endswith(f".{d}") for d in domains)), None)


def _keyed(root) -> list[tuple[str, object]]:
    """What has a key, from one walk for all that is looked for."""
    return [(key.lower(), value) for value, key, _ in walk(root) if key and value is not None]


def _value(roots: list[list[tuple[str, object]]], keys: tuple[str, ...]):
    """The first root's first value whose key ends with one of keys."""
    return next((value for root in roots for key, value in root if key.endswith(keys)), None)


def _person(value) -> dict | None:
    if isinstance(value, str) and value:
        return {"name": value, "url": None, "logo": None}
    if isinstance(value, list):
        return next(filter(None, map(_person, value)), None)
    if isinstance(value, dict):
        first = lambda *keys: next(filter(None, (joined(value.get(k)) for k in keys)), None)
        if name := first("name", "username", "screen_name", "ownerChannelName", "title"):
            return {"name": name, "url": first("url", "canonicalUrl"), "logo": first("logo", "avatar", "image")}
    return None


def _count(value) -> int | None:
    digits = re.sub("[^0-9]", "", joined(value) or "")
    return int(digits) if digits and len(digits) < 19 else None


def _words(value) -> list[str] | None:
    if isinstance(value, list):
        return [t for t in map(joined, value) if t] or None
    text = joined(value) if value else None
    return [t for t in (t.strip() for t in text.split(",")) if t] if text else None


def _linked(nodes: list[dict], kinds: tuple[str, ...], keys: tuple[str, ...]) -> str | None:
    for n in nodes:
        if any(t.lower().endswith(kinds) for t in types_of(n)):
            for k in keys:
                if text := joined(n.get(k)):
                    return text
    return None


def _at(data: dict, path: str):
    for k in path.split("."):
        data = data.get(k) if isinstance(data, dict) else None
    return data


def _rendered(roots: list[dict], renderers: tuple[str, ...], keys: tuple[str, ...]) -> str | None:
    """A text of the first record under one of the renderer keys that has one."""
    for root in roots:
        for value, key, _ in walk(root):
            if key in renderers and isinstance(value, dict):
                for k in keys:
                    if text := joined(value.get(k)):
                        return text
    return None


def _youtube(url: str, items: list[tuple[str, str | None, dict]]) -> dict:
    parts = urlsplit(url)
    query = dict(p.partition("=")[::2] for p in parts.query.split("&"))
    host = (parts.hostname or "").removeprefix("www.")
    video = parts.path.strip("/").split("/")[0] if host == "youtu.be" else query.get("v") if parts.path == "/watch" else (m := re.search(r"/(?:embed|shorts)/([^/?]+)", parts.path)) and m[1]
    player, initial = ([d for s, _, d in items if s == source] for source in ("youtubePlayerResponse", "youtubeInitialData"))
    played = lambda *paths: next((t for d in player for p in paths if (t := joined(_at(d, p)))), None)
    title = _rendered(initial, ("videoPrimaryInfoRenderer", "watchMetadata"), ("title",))
    if not title and video:
        title = next((t for d in initial for v, _, _ in walk(d) if isinstance(v, dict) and joined(v.get("videoId")) == video and (t := joined(v.get("title")))), None)
    if not title and "/post/" in parts.path:
        texts = [squash(t) for d in initial for v, k, _ in walk(d) if k and k.lower().endswith("contenttext") and (t := joined(v))]
        title = max(filter(None, texts), key=len, default=None) or _rendered(initial, ("backstagePostRenderer", "postRenderer"), ("contentText", "title"))
    named = _rendered(initial, ("playlistMetadataRenderer", "playlistHeaderRenderer"), ("title", "playlistTitle", "name"))
    videos: dict[str, dict] = {}
    if query.get("list"):
        for _, _, d in items:
            for v, _, _ in walk(d):
                if isinstance(v, dict):
                    id_ = joined(v.get("videoId")) or joined(v.get("video_id")) or joined(_at(v, "watchEndpoint.videoId")) or joined(_at(v, "navigationEndpoint.watchEndpoint.videoId"))
                    if id_:
                        videos.setdefault(id_, {"id": id_, "title": joined(v.get("title")) or joined(v.get("headline")) or joined(v.get("shortBylineText")), "url": f"https://www.youtube.com/watch?v={id_}"})
    return {
        "player_title": played("videoDetails.title", "microformat.playerMicroformatRenderer.title"),
        "player_description": played("videoDetails.shortDescription", "microformat.playerMicroformatRenderer.description", "microformat.playerMicroformatRenderer.shortDescription"),
        "initial_title": title or (named if query.get("list") and not video else None),
        "initial_description": _rendered(initial, ("expandableVideoDescriptionBodyRenderer", "videoSecondaryInfoRenderer", "watchMetadata"), ("description", "attributedDescription", "content")),
        "playlist_title": named,
        "playlist": list(videos.values())[:MOST_VIDEOS],
    }


def clean_text(text: str | None) -> str | None:
    """Nothing of templates and of the site's own advertising."""
    text = squash(text)
    return None if not text or _LOW_QUALITY.search(text) else text


def _tiktok(url: str, items: list[tuple[str, str | None, dict]]) -> dict:
    path = urlsplit(url).path
    user = m[1] if (m := re.search(r"@([^/]+)", path)) else None
    post = m[1] if (m := re.search(r"/(?:video|photo)/([^/]+)", path)) else next(reversed([p for p in path.split("/") if p]), None)
    fits = lambda v: isinstance(v, dict) and (not post or joined(v.get("id")) == post)
    found = next((v for _, _, d in items if fits(v := (d.get("__DEFAULT_SCOPE__") or {}).get("webapp.video-detail", {}).get("itemInfo", {}).get("itemStruct") if isinstance(d.get("__DEFAULT_SCOPE__"), dict) else None)), None)
    item = found or next((v for _, _, d in items for v, k, _ in walk(d) if k == "itemStruct" and fits(v)), {})
    record = lambda k: v if isinstance(v := item.get(k), dict) else {}
    video, music, author = record("video"), record("music"), record("author")
    tune, by = clean_text(joined(music.get("title"))), clean_text(joined(music.get("authorName")))
    name = joined(author.get("nickname")) or joined(author.get("uniqueId")) or user
    created, size = _count(item.get("createTime")), {"width": _count(video.get("width")), "height": _count(video.get("height"))}
    urls = lambda v: [v.strip()] if isinstance(v, str) and v.strip() else [u for x in v for u in urls(x)] if isinstance(v, list) else []
    play = lambda v: urls(v.get("UrlList")) if isinstance(v, dict) else []
    covers = [*(joined(video.get(k)) for k in ("originCover", "cover", "dynamicCover")), *urls(video.get("shareCover"))]
    plays = [joined(video.get("playAddr")), joined(video.get("downloadAddr")), *play(video.get("PlayAddrStruct"))]
    plays += [u for b in (video.get("bitrateInfo") if isinstance(video.get("bitrateInfo"), list) else []) if isinstance(b, dict) for u in play(b.get("PlayAddr"))]
    make = lambda places, **more: [asset(r, source="applicationJson", **size, **more) for u in dict.fromkeys(filter(None, places)) if (r := resolve(u, url))]
    return {
        "item_text": clean_text(joined(item.get("desc"))),
        "item_music": f"{tune} - {by}" if tune and by and not re.search("original sound", tune, re.I) else tune,
        "item_person": {"name": name, "url": f"https://www.tiktok.com/@{user}" if user else None, "logo": None} if name else None,
        "item_published": datetime.fromtimestamp(created, UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") if created and created < 10**11 else None,
        "item_duration": joined(video.get("duration")),
        "item_plays": _count(record("stats").get("playCount")),
        "item_images": make(covers, kind="image", tiktokMediaKind="videoCover"),
        "item_videos": make([u for u in plays if u and re.match("https?://", u, re.I)], kind="video", type="video/mp4", tiktokMediaKind="videoPlay"),
    }


def site_facts(url: str, nodes: list[dict], items: list[tuple[str, str | None, dict]]) -> dict | None:
    site = site_of(url)
    if not site:
        return None
    data, linked = [_keyed(d) for _, _, d in items], [_keyed(n) for n in nodes]
    person = _person(_value(linked, PEOPLE[site])) or next(filter(None, (_person(_value([d], PEOPLE[site])) for d in data)), None)
    tags = _words(_value(linked, ("tags", "keywords"))) or next(filter(None, (_words(_value([d], ("tags", "keywords"))) for d in data)), None)
    counts = [_count(_value(linked, ("viewcount", "views"))), *(_count(_value([d], ("viewcount", "views"))) for d in data)]
    facts = {
        "person": person, "published": joined(_value(linked, ("datepublished", "uploaddate", "createdat"))), "tags": tags, "views": next((c for c in counts if c is not None), None),
        "ld_video_title": _linked(nodes, ("videoobject",), ("name", "headline")), "ld_video_description": _linked(nodes, ("videoobject",), ("description",)),
        "ld_post_title": _linked(nodes, _POSTS, ("headline", "name")), "ld_post_description": _linked(nodes, _POSTS, ("description", "articleBody")),
        "reddit_payload": any(s == "applicationJson" and p == "reddit-json" for s, p, _ in items),
    }
    return facts | (_youtube(url, items) if site == "youtube" else _tiktok(url, items) if site == "tiktok" else {})
