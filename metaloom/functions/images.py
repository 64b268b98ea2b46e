"""Sizes of pictures from the first bytes of their files: PNG, JPEG and WebP."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_START_OF_FRAME = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        (length,) = struct.unpack_from(">H", b, at + 2)
        if length < 2:
            return None
        if b[at + 1] in _START_OF_FRAME:
            height, width = struct.unpack_from(">HH", b, at + 5)
            return width, height
        at += 2 + length
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if kind == b"VP8 " and len(b) >= 30:
        width, height = struct.unpack_from("<HH", b, 26)
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L" and len(b) >= 25:
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def size_of(data: bytes | None, content_type: str | None) -> tuple[int, int] | None:
    """Width and height; the content type goes before what the bytes look like."""
    if not data or len(data) < 16:
        return None
    kind = (content_type or "").lower()
    if "png" in kind or data.startswith(b"\x89PNG"):
        return struct.unpack_from(">II", data, 16) if len(data) >= 24 else None
    if "jpeg" in kind or "jpg" in kind or data.startswith(b"\xff\xd8"):
        return _jpeg(data)
    if "webp" in kind or (data.startswith(b"RIFF") and data[8:12] == b"WEBP"):
        return _webp(data)
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def dimensions(data: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    found = [size_of(None if b is None else bytes(b), t) or (None, None) for b, t in zip(data, content_type, strict=True)]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")
