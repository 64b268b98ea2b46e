"""Plugins as Python functions of one page, run where the page is read; what one of them raises costs its page a warning and nothing else.

A function gets a dict: url, html, the caller's other columns under their names, and the scan's columns (title, metas, links, jsonld ...). It returns None or a
dict with some of FIELDS. What doesn't fit a field (a text that is none, a list of pictures that is none) counts as an error of the function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.operators import adapters, assets

FIELDS = ("title", "description", "siteName", "canonicalUrl", "type", "publishedTime", "images")
SCHEMA = "plugin_rows array<struct<plugin:string," + ",".join(f"{f}:{'array<string>' if f == 'images' else 'string'}" for f in FIELDS) + ">>, plugin_warnings array<string>"
#: What a plugin is called in warnings, its name, and the function.
Function = tuple[str, str, Callable[[dict], dict | None]]


def run(functions: tuple[Function, ...], page: dict) -> dict:
    """plugin_rows and plugin_warnings of a page."""
    rows, warnings = [], []
    for kind, name, function in functions:
        try:
            made = function(page)
            if made:
                rows.append({"plugin": name} | {f: _fitting(f, made.get(f)) for f in FIELDS})
        except Exception as e:  # noqa: BLE001
            warnings.append(f'{kind} "{name}" failed: {e}'.encode(errors="replace").decode())
    return {"plugin_rows": rows, "plugin_warnings": warnings}


def _fitting(field: str, value):
    if value is None or field != "images" and isinstance(value, str):
        pass
    elif field == "images" and isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value):
        for v in value:
            v.encode()
        return list(value)
    else:
        raise TypeError(f"{field} can't be {value!r:.80}")
    if value is not None:
        value.encode()  # halves of surrogate pairs don't fit a column
    return value


def result_of(name: str) -> Column:
    """The result of a function, as those of other plugins and adapters; null where it returned nothing."""

    def made(row: Column) -> Column:
        images = F.transform(row.images, lambda u: assets.asset(u, "image", name))
        return adapters.result(source=F.lit(name), images=F.coalesce(images, assets.none()), **{f: row[f] for f in FIELDS if f != "images"})

    # The row is bound by transform(), so it is looked up once and not for each of its fields.
    return F.get(F.transform(F.filter("plugin_rows", lambda r: r.plugin == name), made), F.lit(0))
