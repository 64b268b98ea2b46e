"""The one Python stage of the engine: a page's markup becomes nested columns, everything after it is Catalyst.

scan() adds the columns of SCAN to (page_id, url, html). A row whose URL can't be resolved keeps null columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metaloom.functions.batches import pieces
from metaloom.functions.js import squash, text_score
from metaloom.functions.ship import ship
from metaloom.functions.urls import resolve
from metaloom.sources.html import Element, elements
from metaloom.sources.media import ASSET, in_payload, markup
from metaloom.sources.payload import LONGEST_KEY, compact, embedded, entities_of, entity_of, field_score, joined, keywords_of, linked_data, record_of, text_of, texts_of, types_of, walk
from metaloom.sources.sites import SITE, site_facts

ENTITY = "struct<name:string,url:string,logo:string,sameAs:array<string>>"
NODE = (
    "struct<types:array<string>,headline:string,name:string,description:string,url:string,resolved:string,section:string,published:string,modified:string,keywords:array<string>,"
    f"authors:array<{ENTITY}>,publisher:{ENTITY},self:{ENTITY},brand:{ENTITY},sku:string,price:string,currency:string,availability:string,condition:string,rating:string,reviews:string,"
    "category:string,system:string,uploaded:string,duration:string,video_id:string,json:string>"
)
WALK = f"struct<item:int,source:string,key:string,text:string,score:int,site_text:string,site_score:int,entity:{ENTITY},list:array<string>,resolved:string>"
SCAN = (
    "final_url string, title string, metas array<struct<name:string,property:string,itemprop:string,content:string,resolved:string>>, "
    "links array<struct<rel:array<string>,rel_text:string,href:string,resolved:string,type:string,title:string,hreflang:string,sizes:string>>, "
    f"dom_images array<{ASSET}>, dom_videos array<{ASSET}>, dom_audio array<{ASSET}>, json_images array<{ASSET}>, json_videos array<{ASSET}>, json_audio array<{ASSET}>, "
    f"jsonld array<{NODE}>, jsonld_warnings array<string>, embedded array<struct<source:string,path:string,json:string>>, embedded_warnings array<string>, walk array<{WALK}>, site {SITE}"
)
COLUMNS = tuple(re.findall(r"(?:^|, )([a-z_]+) (?:string|array|struct)", SCAN))
#: Keys whose values fields are made of: equal, or (for people and organisations, and for sites) contained or at the end.
_EQUAL = frozenset(
    "canonicalurl canonical permalink pageurl shareurl title headline pagetitle ogtitle name description excerpt summary subtitle ogdescription sitename site_name appname applicationname posttitle pintitle "
    "projecttitle datepublished publishedtime published_at createdat created_at timestamp videoid video_id videotitle publishdate uploaddate duration lengthseconds category viewcount views tags keywords".split()
)
_CANONICAL = frozenset(("canonicalurl", "canonical", "permalink", "pageurl", "shareurl"))
_ENTITIES = ("author", "creator", "owner", "user", "publisher", "provider", "organization", "channel")
_ENDS = ("title", "headline", "name", "description", "desc", "summary", "excerpt", "caption", "text", "datepublished", "publishedtime", "published_at", "createdat", "created_at", "uploaddate", "timestamp", "edge_media_to_caption", "duration", "lengthseconds", "approxdurationms", "category", "selftext", "body")
_SITE_GENERIC = re.compile(r"^(home|login|index|untitled)$", re.I)
_MEDIA_META = re.compile(r"og:(?:url|image|video|audio)|twitter:(?:image|player)")


def _node(n: dict, base: str) -> dict:
    offers, rating = record_of(n.get("offers")) or {}, record_of(n.get("aggregateRating")) or {}
    ids = [t for v, k, _ in walk(n) if k and k.lower() in ("videoid", "video_id") and (t := text_of(v)) and len(t) >= 2 and not t.isdigit()]
    return {
        "types": types_of(n), "headline": text_of(n.get("headline")), "name": text_of(n.get("name")), "description": text_of(n.get("description")), "url": text_of(n.get("url")), "resolved": resolve(text_of(n.get("url")), base),
        "section": text_of(n.get("articleSection")), "published": text_of(n.get("datePublished")), "modified": text_of(n.get("dateModified")), "keywords": keywords_of(n.get("keywords")),
        "authors": entities_of(n.get("author")), "publisher": entity_of(n.get("publisher")), "self": entity_of(n), "brand": entity_of(n.get("brand")), "sku": text_of(n.get("sku")),
        "price": text_of(offers.get("price")), "currency": text_of(offers.get("priceCurrency")), "availability": text_of(offers.get("availability")), "condition": text_of(offers.get("itemCondition")),
        "rating": text_of(rating.get("ratingValue")), "reviews": text_of(rating.get("reviewCount")), "category": text_of(n.get("applicationCategory")), "system": text_of(n.get("operatingSystem")),
        "uploaded": text_of(n.get("uploadDate")), "duration": text_of(n.get("duration")), "video_id": max(ids, key=field_score, default=None), "json": compact(n),
    }


def _told(key: str) -> tuple[str, bool, bool, bool]:
    """A key in lower case, and whether it names people, a field or a field of a site."""
    low = key.lower()
    return low, any(k in low for k in _ENTITIES), low in _EQUAL, low.endswith(_ENDS)


_told_once = lru_cache(maxsize=1 << 12)(_told)


def _walked(items: list[tuple[str, str | None, dict]], base: str) -> Iterator[dict]:
    for i, (source, _, data) in enumerate(items):
        for value, key, _ in walk(data):
            if not key:
                continue
            low, person, equal, ends = _told_once(key) if len(key) <= LONGEST_KEY else _told(key)
            if person or equal or ends:
                text = text_of(value)
                site = squash(joined(value)) if ends else None
                yield {
                    "item": i, "source": source, "key": low, "text": text, "score": field_score(text) if text else None, "site_text": site,
                    "site_score": text_score(site, 180, (60, 10, 140), 100, _SITE_GENERIC) if site else None, "entity": entity_of(value) if person else None, "list": texts_of(value) if low in ("tags", "keywords") else None,
                    "resolved": resolve(text, base) if low in _CANONICAL else None,
                }


#: Columns that need linked data, application data and both.
_NODES, _ITEMS = ("jsonld", "jsonld_warnings"), ("embedded", "embedded_warnings", "walk")
_JSON_MEDIA = {"json_images": "image", "json_videos": "video", "json_audio": "audio"}
_MARKUP = ("dom_images", "dom_videos", "dom_audio")


def scan_page(url: str | None, html: str | None, wanted: Container[str] = COLUMNS) -> dict | None:
    """The wanted columns of a page; None for a URL that can't be used."""
    base = resolve(url)
    if base is None:
        return None
    found = elements(html or "")
    page: dict = {"final_url": base}
    if "title" in wanted:
        page["title"] = squash(next((e.text for e in found if e.tag == "title"), None))
    if "metas" in wanted:
        page["metas"] = list(_metas(found, base))
    if "links" in wanted:
        page["links"] = list(_links(found, base))
    both = "site" in wanted or any(c in wanted for c in _JSON_MEDIA)
    nodes: list[dict] = []
    items: list[tuple[str, str | None, dict]] = []
    scripts = [(e.get("type") or "", e.get("id"), e.text) for e in found if e.tag == "script"]
    if both or any(c in wanted for c in _NODES):
        nodes, page["jsonld_warnings"] = linked_data([(t, x) for t, _, x in scripts])
    if both or any(c in wanted for c in _ITEMS):
        items, page["embedded_warnings"] = embedded(scripts)
    if "jsonld" in wanted:
        page["jsonld"] = [_node(n, base) for n in nodes]
    if "embedded" in wanted:
        page["embedded"] = [{"source": s, "path": p, "json": compact(d)} for s, p, d in items]
    if "walk" in wanted:
        page["walk"] = list(_walked(items, base))
    if "site" in wanted:
        page["site"] = site_facts(base, nodes, items)
    media = {kind: c for c, kind in _JSON_MEDIA.items() if c in wanted}
    if media:
        page |= {media[kind]: assets for kind, assets in in_payload(nodes, items, media, base).items()}
    if any(c in wanted for c in _MARKUP):
        page |= zip(_MARKUP, markup(found, base), strict=True)
    return page


def _metas(found: list[Element], base: str) -> Iterator[dict]:
    for e in found:
        if e.tag == "meta" and e.get("content"):
            m = {k: squash(e.get(k)) for k in ("name", "property", "itemprop", "content")}
            if m["content"]:
                m["resolved"] = resolve(m["content"], base) if _MEDIA_META.match(m["property"] or "") or _MEDIA_META.match(m["name"] or "") else None
                yield m


def _links(found: list[Element], base: str) -> Iterator[dict]:
    for e in found:
        if e.tag == "link" and (rel := squash(e.get("rel"))) and (href := squash(e.get("href"))):
            yield {"rel": rel.lower().split(), "rel_text": rel.lower(), "href": href, "resolved": resolve(href, base), **{k: squash(e.get(k)) for k in ("type", "title", "hreflang", "sizes")}}


def unread(url: str | None, error: Exception) -> dict:
    """What stands for a page that can't be read: empty, with a warning."""
    empty: dict = dict.fromkeys(COLUMNS, []) | dict.fromkeys(("final_url", "title", "site"))
    try:
        empty["final_url"] = resolve(url)
    except Exception:  # noqa: BLE001
        pass
    return empty | {"jsonld_warnings": [f"Could not read page: {type(error).__name__}"]}


def safe_page(url: str | None, html: str | None, wanted: Container[str] = COLUMNS) -> dict | None:
    """scan_page(), with a warning instead of an error."""
    try:
        return scan_page(url, html, wanted)
    except Exception as e:  # noqa: BLE001
        return unread(url, e)


def scan(pages: DataFrame, columns: Iterable[str] | None = None, rows_per_batch: int = 256, more: tuple[str, Callable[[dict], dict]] | None = None) -> DataFrame:
    """pages has url and html, and whatever else is to be kept; columns are those of SCAN that are wanted, all by default.

    Catalyst can't see what Python needs, so what isn't wanted must be said: linked data, application data, media and walks are
    only read for columns that hold them. Batches are worked through in small pieces, as a page can hold megabytes. A page that can't
    be read becomes a row without content and with a warning, and never fails the others. more is the schema of further columns and a function that
    makes them of a page: the dict of its columns, whatever the caller's are called (without in_), url and html.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    ship(spark)
    kept = [f for f in pages.schema if f.name != "html"]
    schema = StructType([*kept, *(f for f in _schema(spark) if columns is None or f.name in columns)])
    wanted = frozenset(schema.names[len(kept) :])
    if more:
        schema = StructType([*schema, *spark.createDataFrame([], more[0]).schema])
    arrow = to_arrow_schema(schema)
    made = arrow.names[len(kept) :]

    def column(rows: list[dict], name: str) -> pa.Array:
        return pa.array([r[name] for r in rows], arrow.field(name).type)

    def arrays(urls: list[str | None], rows: list[dict]) -> list[pa.Array]:
        try:
            return [column(rows, c) for c in made]
        except Exception:  # noqa: BLE001
            for i, r in enumerate(rows):  # a row with a value that no column can hold
                try:
                    for c in made:
                        column([r], c)
                except Exception as e:  # noqa: BLE001
                    rows[i] = unread(urls[i], e)
            return [column(rows, c) for c in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, rows_per_batch):
                urls = batch.column("url").to_pylist()
                texts = batch.column("html").to_pylist()
                rows = [safe_page(u, h, wanted) or dict.fromkeys(made) for u, h in zip(urls, texts, strict=True)]
                if more:
                    own = [batch.column(f.name).to_pylist() for f in kept]
                    names = [f.name.removeprefix("in_") for f in kept]
                    for i, (row, html) in enumerate(zip(rows, texts, strict=True)):
                        row |= more[1](dict(zip(names, (c[i] for c in own), strict=True)) | row | {"html": html})
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + arrays(urls, rows), names=arrow.names)

    return pages.mapInArrow(run, schema)


def _schema(spark: SparkSession) -> StructType:
    return spark.createDataFrame([], SCAN).schema
