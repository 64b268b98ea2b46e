"""URLs: a resolver after the URL standard for http(s), and Column expressions on resolved URLs."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_EDGE = "".join(map(chr, range(33)))
_FORBIDDEN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_PORTS = {"http": "80", "https": "443"}
#: Signs that stay as they are in paths and queries, beside letters and digits.
_PATH, _QUERY = "!$%&'()*+,-./:;=@[\\]_|~^", "!$%&()*+,-./:;=?@[\\]^_`{|}~"
#: A path that stays as it is: nothing to quote, and no segment that begins with a dot, written as %2e or not.
_PLAIN = re.compile(rf"(?:/(?!\.|%2)[A-Za-z0-9{re.escape(_PATH.replace('/', ''))}]*+)++")
#: A URL that is normalised already: a name in lower case that can't be an address, a path and a query that stay as they are.
_NORMAL = re.compile(rf"https?://(?:[a-z0-9-]+\.)*+[a-z][a-z0-9-]*+{_PLAIN.pattern.replace(re.escape(chr(92)), '')}(?:\?[A-Za-z0-9{re.escape(_QUERY.replace(chr(92), ''))}]++)?+")
#: Hosts of URL shorteners.
SHORT_HOSTS = {"pin.it": "Pinterest", "redd.it": "Reddit", "t.co": "X", "bit.ly": "Bitly", "tinyurl.com": "TinyURL", "youtu.be": "YouTube"}


def _number(part: str) -> int | None:
    try:
        if part[:2] in ("0x", "0X"):
            return int(part[2:] or "0", 16)
        if len(part) > 1 and part[0] == "0":
            return int(part, 8)
        return int(part) if part.isascii() and part.isdigit() else None
    except ValueError:
        return None


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1])}]" if raw.endswith("]") else None
        except ValueError:
            return None
    host = unquote(raw)
    try:
        host = host.lower() if host.isascii() else host.encode("idna").decode().lower()
    except UnicodeError:
        return None
    if not host or _FORBIDDEN.search(host):
        return None
    parts = host.removesuffix(".").split(".")
    if parts[-1] and (parts[-1].isdigit() or re.fullmatch("0[xX][0-9a-fA-F]*", parts[-1])):  # it must be an IPv4 address
        numbers = [_number(p) if p else None for p in parts]
        if len(parts) > 4 or None in numbers or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(x << (8 * (3 - i)) for i, x in enumerate(numbers[:-1]))
        return str(ipaddress.IPv4Address(value))
    return host


def _path(raw: str) -> str:
    if _PLAIN.fullmatch(raw):
        return raw
    out: list[str] = []
    segments = raw.split("/")[1:]
    for i, s in enumerate(segments):
        dots = s.lower().replace("%2e", ".")
        if dots == "..":
            out = out[:-1]
        elif dots != ".":
            out.append(s)
        if dots in (".", "..") and i == len(segments) - 1:
            out.append("")
    return quote("/" + "/".join(out), safe=_PATH)


@lru_cache(maxsize=1 << 14)
def split(url: str) -> tuple[str, str, str, str] | None:
    """Scheme, authority, path and query (with its question mark) of an absolute http(s) URL, all normalised."""
    url = re.sub("[\t\n\r]", "", url.strip(_EDGE))
    m = _SCHEME.match(url)
    if not m or (scheme := m[1].lower()) not in _PORTS:
        return None
    rest, _, _ = url[m.end() :].partition("#")
    before, mark, query = rest.partition("?")
    before = before.replace("\\", "/").lstrip("/")
    authority, slash, path = before.partition("/")
    user, at, place = authority.rpartition("@")
    name, colon, port = place, "", ""
    if (p := re.search(r":([0-9]*)$", place)) and not place.endswith("]"):
        name, colon, port = place[: p.start()], ":", p[1]
    host = _host(name)
    port = port and (port.lstrip("0") or "0")
    if host is None or len(port) > 5 or (port and int(port) > 65535):
        return None
    shown = f"{quote(user, safe='!$%&()*+,-.:_~')}@" * bool(at and user) + host + f":{port}" * bool(port and port != _PORTS[scheme])
    return scheme, shown, _path("/" + path), mark and query and "?" + quote(query, safe=_QUERY)


def resolve(url: str | None, base: str | None = None) -> str | None:
    """The absolute URL without fragment; None where it isn't http(s) or can't be read."""
    if not url:
        return None
    if _NORMAL.fullmatch(url):
        return url
    url = url.strip(_EDGE)
    if not url.isprintable():
        url = re.sub("[\t\n\r]", "", url)
    m = _SCHEME.match(url)
    if m and not (base and m[1].lower() == base.split(":", 1)[0].lower() and not re.match(r"[/\\]", url[m.end() :])):
        found = split(url)
        return f"{found[0]}://{''.join(found[1:])}" if found else None
    of = split(base) if base else None
    if not of:
        return None
    if m:
        url = url[m.end() :]
    scheme, authority, path, query = of
    rest, _, _ = url.partition("#")
    before, mark, after = rest.partition("?")
    before = before.replace("\\", "/")
    if before.startswith("//"):
        found = split(f"{scheme}:{before}{mark}{after}")
        return f"{found[0]}://{''.join(found[1:])}" if found else None
    if before:
        path, query = _path(before if before.startswith("/") else path[: path.rfind("/") + 1] + before), ""
    if mark:
        query = after and "?" + quote(after, safe=_QUERY)
    return f"{scheme}://{authority}{path}{query}"


@F.pandas_udf(StringType())
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return pd.Series([resolve(u) for u in url], dtype=object)


#: The same for tables that are filtered by its result: Spark would ask a deterministic function once for the filter and again for the column.
normalize_url_once = F.pandas_udf(normalize_url.func, StringType()).asNondeterministic()


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_value(url: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def domain_of(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def host_is(host: Column, *domains: str) -> Column:
    """The host is one of the domains or below one."""
    fits = F.lit(False)
    for d in domains:
        fits = fits | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return fits


def short_provider(url: Column) -> Column:
    """The shortener behind a URL, null for others."""
    table = F.create_map(*[F.lit(x) for pair in SHORT_HOSTS.items() for x in pair])
    return F.try_element_at(table, F.coalesce(domain_of(url), F.lit("")))


def signature_of(url: Column) -> Column:
    """What tells one picture from another: host and path without one size suffix, in lower case."""
    path = F.regexp_replace(path_of(url), r"^(.*?)(?i:[-_](?:\d{2,5}x\d{2,5}|\d{2,5}w|small|medium|large|thumb|thumbnail))(?=\.)", "$1")
    return F.coalesce(F.concat(host_of(url), F.lower(path)), F.lower(url))


def ip_class(address: Column) -> Column:
    """public, loopback, private, linkLocal or reserved; names count as public."""
    v4 = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.|$)){4}$") & ~F.endswith(address, F.lit("."))
    a, b = (F.nullif(F.regexp_extract(address, p, 1), F.lit("")).try_cast("int") for p in (r"^(\d+)\.", r"^\d+\.(\d+)\."))
    low = F.lower(address)
    begins = lambda *p: low.rlike("^(?:" + "|".join(p) + ")")
    four = (
        F.when(a == 127, "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 169) & (b == 254), "linkLocal")
        .when((a == 0) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0)) | ((a == 198) & b.isin(18, 19)), "reserved")
        .otherwise("public")
    )
    six = F.when(low.isin("::1", "0:0:0:0:0:0:0:1"), "loopback").when(begins("fc", "fd"), "private").when(begins("fe[89ab]"), "linkLocal").when((low == "::") | begins(r"::ffff:127\.", r"::ffff:10\."), "reserved").otherwise("public")
    return F.when(v4, four).when(F.contains(address, F.lit(":")), six).otherwise("public")


def is_local_name(host: Column) -> Column:
    name = F.regexp_replace(F.lower(host), r"\.$", "")
    return (name == "localhost") | F.endswith(name, F.lit(".localhost"))


def is_reddit(url: Column) -> Column:
    return on_reddit(domain_of(url))


def on_reddit(domain: Column) -> Column:
    return F.coalesce(domain.isin("reddit.com", "redd.it") | F.endswith(domain, F.lit(".reddit.com")), F.lit(False))


def youtube_id(url: Column) -> Column:
    host, path = domain_of(url), path_of(url)
    piece = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    return F.when(host == "youtu.be", piece(r"^/([^/]+)")).when(path == "/watch", query_value(url, "v")).otherwise(piece(r"^/(?:embed|shorts)/([^/]+)"))


def url_dimension(url: Column, side: str) -> Column:
    """Width or height that a URL's query states (width, w, height, h or crop=W:H)."""
    at = 1 if side == "width" else 2
    crop = F.regexp_extract(url, r"[?&]crop=(?:[^&#]*?)(\d+)(?::|%3A)(\d+)", at)
    return F.coalesce(*[F.nullif(F.regexp_extract(url, rf"[?&]{k}=(\d+)", 1), F.lit("")).try_cast("double") for k in (side, side[0])], F.nullif(crop, F.lit("")).try_cast("double"))
