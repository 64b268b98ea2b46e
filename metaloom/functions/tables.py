"""Table functions for SQL users: SELECT * FROM pages, LATERAL web_media(html, url)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from metaloom.functions.ship import ship
from metaloom.functions.urls import normalize_url, resolve_url
from metaloom.sources.pages import safe_page

_FIELDS = ("url", "kind", "source", "type", "width", "height", "alt")


class WebMedia:
    """Media of a page's markup and data, in order."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        page = safe_page(url, html) or {}
        for part in ("json_images", "dom_images", "json_videos", "dom_videos", "json_audio", "dom_audio"):
            for a in page.get(part) or ():
                yield tuple(a[f] for f in _FIELDS)


def register(spark: SparkSession) -> None:
    """Makes web_media, resolve_url and normalize_url known to SQL."""
    ship(spark)
    kinds = {"width": DoubleType(), "height": DoubleType()}
    spark.udtf.register("web_media", F.udtf(WebMedia, returnType=StructType([StructField(f, kinds.get(f, StringType())) for f in _FIELDS])))
    spark.udf.register("resolve_url", resolve_url)
    spark.udf.register("normalize_url", normalize_url)
