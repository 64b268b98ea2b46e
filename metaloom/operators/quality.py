"""Confidence, completeness and reliability of a record, as arithmetic on its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.js import GENERIC, rounded, squashed, units


def within(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def text_points(text: Column, most: float, shortest: int, longest: int) -> Column:
    """Points for a text: fewer below the shortest and above the longest good length, and for generic words."""
    plain = squashed(text)
    n = units(plain)
    by_length = F.when(n < shortest, n / shortest).when(n > longest, F.greatest(F.lit(0.4), longest / n)).otherwise(1.0)
    return F.when(plain.isNotNull(), most * by_length * F.when(plain.rlike(GENERIC), 0.35).otherwise(1.0)).otherwise(0.0)


def source_bonus(source: Column) -> Column:
    return (
        F.when(source == "adapter", 8)
        .when(source.isin("openGraph", "twitter"), 7)
        .when(source.isin("jsonLd", "oEmbed"), 6)
        .when(source.isin("nextData", "nuxt", "initialState", "preloadedState", "apollo", "applicationJson"), 5)
        .when(source == "html", 3)
        .otherwise(1)
    )


def confidence(title: Column, description: Column, image_score: Column, image_source: Column, canonical: Column, structured: Column, adapter_ok: Column, graph: Column, card: Column, state: Column, warnings: Column) -> Column:
    """image_score is null without an image; structured, adapter_ok, graph, card and state are booleans, warnings a count."""
    image = F.when(image_score.isNotNull(), 18 + F.least(image_score, F.lit(100.0)) * 0.12 + source_bonus(image_source)).otherwise(0.0)
    flag = lambda test, n: F.when(test, n).otherwise(0)
    total = text_points(title, 18, 6, 120) + text_points(description, 16, 24, 300) + image + flag(canonical.isNotNull(), 10)
    total = total + flag(structured, 12) + flag(adapter_ok, 8) + flag(graph, 6) + flag(card, 4) + flag(state, 6) - F.least(warnings * 3, F.lit(18))
    return rounded(within(total))


def breakdown(title: Column, description: Column, image_score: Column, image_source: Column, structured: Column, state: Column, adapter: Column) -> Column:
    """The parts on a scale to 100; adapter is the adapter's own confidence, 0 without one."""
    image = F.when(image_score.isNotNull(), within(58 + F.least(image_score, F.lit(100.0)) * 0.27 + source_bonus(image_source))).otherwise(0.0)
    return F.struct(
        rounded(text_points(title, 100, 6, 120)).alias("title"),
        rounded(text_points(description, 100, 24, 300)).alias("description"),
        rounded(image).alias("image"),
        F.when(structured, 100).when(state, 55).otherwise(0).alias("structuredData"),
        rounded(adapter).alias("adapter"),
    )


#: What each part of a complete record is worth.
WEIGHTS = {"title": 20, "description": 16, "image": 20, "canonical": 12, "site": 8, "author": 8, "publisher": 5, "type": 6, "published": 3, "media": 2}


def completeness(**present: Column) -> Column:
    """present: for each part of WEIGHTS whether it is there."""
    return sum((F.when(present[k], n).otherwise(0) for k, n in WEIGHTS.items() if k in present), F.lit(0)).cast("int")


def reliability(confidence: Column, completeness: Column, adapter: Column, image_score: Column, warnings: Column) -> Column:
    image = F.when(image_score >= 80, 10).when(image_score.isNotNull(), 5).otherwise(0)
    return rounded(within(confidence * 0.45 + completeness * 0.3 + F.when(adapter, 10).otherwise(0) + image - F.least(warnings * 4, F.lit(20))))


def adapter_confidence(title: Column, description: Column, media: Column, author: Column, base: int = 45, parts: tuple[int, int, int, int] = (22, 14, 14, 6)) -> Column:
    """Of an adapter's own result; the record's diagnostics use another base and other parts."""
    given = [title.isNotNull(), description.isNotNull(), media, author.isNotNull()]
    return F.least(base + sum((F.when(g, n).otherwise(0) for g, n in zip(given, parts, strict=True)), F.lit(0)), F.lit(100))


DIAGNOSTIC = (55, (15, 10, 15, 5))
