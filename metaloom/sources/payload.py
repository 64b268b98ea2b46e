"""JSON that pages carry: linked data, application state in scripts, and bounded walks over both.

Object keys are walked as browsers order them (whole numbers first, ascending, then as written), in depth-first order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

from metaloom.functions.js import squash, text_score, to_number

LONGEST_SCRIPT, DEEPEST, MOST_ITEMS, MOST_KEYS, KEY_CHARS = 1_500_000, 8, 250, 500, 500
#: What keys name is remembered for those up to this length.
LONGEST_KEY = 64
#: Names that application state is assigned to, by the source they stand for.
ASSIGNED = {
    "nuxt": ["window.__NUXT__", "__NUXT__"],
    "initialState": ["window.__INITIAL_STATE__", "__INITIAL_STATE__"],
    "preloadedState": ["window.__PRELOADED_STATE__", "__PRELOADED_STATE__"],
    "apollo": ["window.__APOLLO_STATE__", "__APOLLO_STATE__", "window.__APOLLO_CLIENT__"],
    "youtubeInitialData": ["ytInitialData", "window.ytInitialData"],
    "youtubePlayerResponse": ["ytInitialPlayerResponse", "window.ytInitialPlayerResponse"],
}
_OPENING = re.compile(r"=\s*[\[{]")
_SIGNS = {k: re.compile(rf'[{re.escape(k)}"]') for k in ("{}", "[]")}
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_SURROGATE, _ESCAPED = re.compile("[\ud800-\udfff]"), re.compile(r"\\u[dD][89a-fA-F]")
_GENERIC = re.compile(r"^(home|login|index|untitled)$", re.I)


def _no_constant(name: str):
    raise ValueError(f"Unexpected token {name}")


def _integer(digits: str) -> int | float:
    """Numbers are doubles; those of many digits may be infinite."""
    return int(digits) if len(digits) < 300 else float(digits)


def whole(value):
    """The value with U+FFFD for halves of surrogate pairs, which no UTF-8 text can hold."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if _SURROGATE.search(value) else value
    if isinstance(value, list):
        return [whole(v) for v in value]
    if isinstance(value, dict):
        return {whole(k): whole(v) for k, v in value.items()}
    return value


def parse(text: str):
    value = json.loads(text, parse_constant=_no_constant, parse_int=_integer)
    return whole(value) if _ESCAPED.search(text) else value


def compact(value) -> str:
    """As JSON; numbers that aren't finite become null."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except ValueError:
        return json.dumps(_finite(value), ensure_ascii=False, separators=(",", ":"))


def _finite(value):
    if isinstance(value, list):
        return [_finite(v) for v in value]
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return None if isinstance(value, float) and not isfinite(value) else value


def cleaned(text: str | None) -> str:
    return re.sub("-->$", "", re.sub("^<!--", "", text or "")).strip()


def linked_data(scripts: list[tuple[str, str]]) -> tuple[list[dict], list[str]]:
    """Nodes of the linked-data scripts among (type, text), and a warning for each that can't be read."""
    nodes: list[dict] = []
    warnings: list[str] = []

    def add(value) -> None:
        if isinstance(value, list):
            for v in value:
                add(v)
        elif isinstance(value, dict):
            nodes.append(value)
            if isinstance(value.get("@graph"), list):
                nodes.extend(v for v in value["@graph"] if isinstance(v, dict))

    for i, text in enumerate(text for kind, text in scripts if "ld+json" in kind):
        if source := squash(text):
            try:
                add(parse(cleaned(source)))
            except (ValueError, RecursionError) as e:
                warnings.append(f"Could not parse JSON-LD script at index {i}: {e}")
    return nodes, warnings


def balanced(text: str, start: int) -> str | None:
    """From an opening bracket to its counterpart; brackets of the other kind and those in strings don't count."""
    sign, depth, at = _SIGNS["{}" if text[start] == "{" else "[]"], 0, start
    while m := sign.search(text, at):
        at = m.end()
        if m[0] == '"':
            s = _STRING.match(text, m.start())
            if not s:
                return None
            at = s.end()
        else:
            depth += 1 if m[0] == text[start] else -1
            if depth == 0:
                return text[start:at]
    return None


def assigned(text: str, name: str) -> dict | None:
    """The object or array that follows the first assignment after the name; an array becomes {value: array}."""
    at = text.find(name)
    m = _OPENING.search(text, at + len(name)) if at >= 0 else None
    found = balanced(text, m.end() - 1) if m else None
    if found:
        try:
            value = parse(found)
            return value if isinstance(value, dict) else {"value": value}
        except (ValueError, RecursionError):
            pass
    return None


def embedded(scripts: list[tuple[str, str | None, str]]) -> tuple[list[tuple[str, str | None, dict]], list[str]]:
    """(source, path, data) of application data in scripts (type, id, text), without repetitions, and warnings."""
    items: list[tuple[str, str | None, dict]] = []
    warnings: list[str] = []

    def add(source: str, path: str | None, text: str) -> None:
        if plain := cleaned(text):
            try:
                value = parse(plain)
                if isinstance(value, dict):
                    items.append((source, path, value))
            except (ValueError, RecursionError) as e:
                warnings.append(f"Could not parse {source} embedded JSON{f' at {path}' if path else ''}: {e}")

    for source, name in (("nextData", "__NEXT_DATA__"), ("nuxt", "__NUXT_DATA__")):
        if first := next((text for _, id_, text in scripts if id_ == name), None):
            add(source, None, first)
    for i, (kind, id_, text) in enumerate(scripts):
        if not text or len(text) > LONGEST_SCRIPT:
            continue
        kind = (squash(kind) or "").lower()
        if "application/json" in kind or "application/ld+json" in kind:
            add("jsonScript" if "ld+json" in kind else "applicationJson", squash(id_), text)
        for source, names in ASSIGNED.items():
            for name in names:
                if name in text and (data := assigned(text, name)):
                    items.append((source, name, data))
        if "apollo" in text.lower() and (data := assigned(text, "window.__APOLLO_STATE__") or assigned(text, "__APOLLO_STATE__")):
            items.append(("apollo", f"script[{i}]", data))
    unique = {}
    for source, path, data in items:
        unique.setdefault((source, path or "", compact(data)[:KEY_CHARS]), (source, path, data))
    return list(unique.values()), warnings


def entries(record: dict) -> list[tuple[str, object]]:
    """Keys that are whole numbers come first, ascending."""
    if any(map(str.isdigit, record)):
        numbers = [k for k in record if k.isascii() and k.isdigit() and len(k) <= 10 and str(int(k)) == k and int(k) < 2**32 - 1]
        return [(k, record[k]) for k in sorted(numbers, key=int)] + [(k, v) for k, v in record.items() if k not in set(numbers)]
    return list(record.items())


def walk(value, key: str | None = None, parent: dict | None = None, depth: int = 0) -> Iterator[tuple[object, str | None, dict | None]]:
    """(value, key, enclosing record) in order, down to a depth, with bounded lists and records."""
    waiting = [(value, key, parent, depth)] if depth <= DEEPEST else []
    while waiting:  # generators within generators would hand every value through all levels
        value, key, parent, depth = waiting.pop()
        yield value, key, parent
        if depth == DEEPEST:
            continue
        if isinstance(value, list):
            waiting += [(v, None, parent, depth + 1) for v in reversed(value[:MOST_ITEMS])]
        elif isinstance(value, dict):
            waiting += [(v, k, value, depth + 1) for k, v in reversed(entries(value)[:MOST_KEYS])]


def scalar(value) -> str | None:
    """A trimmed text or a number as text."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, (int, float)) and not isinstance(value, bool) and isfinite(value):
        if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
            return str(int(value))
        return str(value)
    return None


def text_of(value) -> str | None:
    """Of fields: a scalar, the first of a list, or a record's name, url or @id."""
    if isinstance(value, list):
        return next(filter(None, map(text_of, value)), None)
    if isinstance(value, dict):
        return text_of(value.get("name")) or text_of(value.get("url")) or text_of(value.get("@id"))
    return scalar(value)


def place_of(value) -> str | None:
    """Of media: a scalar, or a record's url, src or name."""
    if isinstance(value, dict):
        return place_of(value.get("url")) or place_of(value.get("src")) or place_of(value.get("name"))
    return scalar(value)


def joined(value) -> str | None:
    """Of site data: texts of lists are put together; of records the first of the usual keys."""
    if isinstance(value, list):
        return "".join(filter(None, map(joined, value))) or None
    if isinstance(value, dict):
        for k in ("text", "simpleText", "runs", "title", "name", "value", "url"):
            if found := joined(value.get(k)):
                return found
        return None
    return scalar(value)


def texts_of(value) -> list[str] | None:
    found = [t for t in map(text_of, value if isinstance(value, list) else [value]) if t]
    return found or None


def record_of(value) -> dict | None:
    if isinstance(value, list):
        return next((v for v in value if isinstance(v, dict)), None)
    return value if isinstance(value, dict) else None


def entity_of(value) -> dict | None:
    """A person or organisation; None if nothing is known of it."""
    record = record_of(value)
    if record is None:
        name = text_of(value)
        return {"name": name, "url": None, "logo": None, "sameAs": None} if name else None
    found = {"name": text_of(record.get("name")), "url": text_of(record.get("url")), "logo": text_of(record.get("logo")), "sameAs": texts_of(record.get("sameAs"))}
    return found if any(found.values()) else None


def entities_of(value) -> list[dict] | None:
    found = [e for e in map(entity_of, value if isinstance(value, list) else [value]) if e]
    return found or None


def types_of(node: dict) -> list[str]:
    kinds = node.get("@type")
    return [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]


def keywords_of(value) -> list[str]:
    if isinstance(value, list):
        return [t for t in map(text_of, value) if t]
    text = text_of(value) if value else None
    return [k for k in (k.strip() for k in text.split(",")) if k] if text else []


def field_score(text: str) -> int:
    return text_score(text, 160, (50, 12, 120), 80, _GENERIC)


def number_in(value) -> float | None:
    return to_number(place_of(value))
