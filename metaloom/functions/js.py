"""String and number rules of the web pages' own language, as Column expressions with Python twins.

The scan runs in Python and the rest in Catalyst, so what both need is written twice; tests hold the twins against each other.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that collapses.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"
_SPACE = re.compile(SPACE)
_INTEGER = re.compile(rf"(?:{SPACE})?([+-]?[0-9]+)")
_NUMBER = re.compile(rf"(?:{SPACE})?([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
#: Fixed value: titles that say nothing.
GENERIC = "(?i)^(home|untitled|index|login|sign in)$"


def squash(text: str | None) -> str | None:
    """Runs of white space become one space, the ends are trimmed, and nothing becomes None."""
    if text and " " not in text and text.isascii() and text.isprintable():
        return text
    return (_SPACE.sub(" ", text).strip(" ") or None) if text else None


def squashed(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def defined(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def to_integer(text: str | None) -> float | None:
    """As a double, which is infinite for very many digits."""
    m = _INTEGER.match(text) if text else None
    return float(m[1]) if m else None


def to_number(text: str | None) -> float | None:
    m = _NUMBER.match(text) if text else None
    return float(m[1]) if m else None


def integer_of(text: Column) -> Column:
    """The whole number that the text begins with."""
    return F.nullif(F.regexp_extract(text, f"^(?:{SPACE})?([+-]?[0-9]+)", 1), F.lit("")).cast("double")


def number_of(text: Column) -> Column:
    """The number that the text begins with."""
    return F.nullif(F.regexp_extract(text, rf"^(?:{SPACE})?([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).cast("double")


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5).cast("int")


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    n = F.length(text)
    return F.when(F.octet_length(text) == n, n).otherwise(n + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", "")))


def two_places(score: Column) -> Column:
    """score / 100 to two places by its exact binary value; scores are multiples of a half unless custom scorers say otherwise."""
    halves = F.array(*[F.lit(float(Decimal(i / 200).quantize(Decimal("0.01"), ROUND_HALF_UP))) for i in range(201)])
    return F.when(score * 2 == F.floor(score * 2), F.element_at(halves, (score * 2).cast("int") + 1)).otherwise(F.round(score / 100, 2))


def text_score(text: str, longest: int, bonus: tuple[int, int, int], malus: int, generic: re.Pattern) -> int:
    """How well a text would serve as a title: its length up to a limit, a bonus in a range of lengths, less for generic words."""
    n = len(text.encode("utf-16-le")) // 2
    return min(n, longest) + (bonus[0] if bonus[1] <= n <= bonus[2] else 0) - (malus if generic.search(text) else 0)
