"""What a crawler sends, and text from the bytes that it gets."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The headers of a browser's page request.
HEADERS = {
    "accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,image/apng,*/*;q=0.8,application/signed-exchange;v=b3;q=0.7",
    "accept-language": "en-US,en;q=0.9",
    "accept-encoding": "gzip, deflate, br",
    "cache-control": "no-cache",
    "pragma": "no-cache",
    "sec-ch-ua": '"Chromium";v="125", "Google Chrome";v="125", "Not.A/Brand";v="24"',
    "sec-ch-ua-mobile": "?0",
    "sec-ch-ua-platform": '"Windows"',
    "sec-fetch-dest": "document",
    "sec-fetch-mode": "navigate",
    "sec-fetch-site": "none",
    "sec-fetch-user": "?1",
    "upgrade-insecure-requests": "1",
    "user-agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36",
}
_CHARSET = re.compile(r"charset=([^;]+)", re.I)


def request_headers(own: dict[str, str] | None = None) -> dict[str, str]:
    """The headers of a request; own ones go before the defaults, whatever their case."""
    return HEADERS | {k.lower(): v for k, v in (own or {}).items()}


def charset_of(content_type: str | None) -> str:
    """The charset that a content type names, UTF-8 for none or an unknown one."""
    m = _CHARSET.search(content_type or "")
    name = m[1].strip().strip("\"'") if m else ""
    try:
        return codecs.lookup(name).name
    except LookupError:
        return "utf-8"


def decoded(data: bytes | None, content_type: str | None) -> str | None:
    """A body's text without byte order mark; bytes that don't fit become U+FFFD."""
    if data is None:
        return None
    name = charset_of(content_type)
    return bytes(data).decode("cp1252" if name in ("iso8859-1", "ascii") else name, "replace").removeprefix("﻿")


@F.pandas_udf(StringType())
def decode_body(data: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decoded(b, t) for b, t in zip(data, content_type, strict=True)], dtype=object)
