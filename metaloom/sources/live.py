"""Requests from Spark: a data source for lists of URLs and an operator for tables of them.

    register(spark)
    spark.read.format("metaloom_http").option("urls", json.dumps([...])).load()       # a list, up to MOST_LISTED
    fetch_pages(table_of_urls, Settings(most_bytes=500_000))                           # a table, of any size

Both give one row for each URL: url, final_url, redirects, status, content_type, body (text), bytes, retry_after, error, attempts, and
responses, the answers of all hops in the form that metaloom.operators.fetch replays. Work is dealt by host: a host's URLs are one task's, which asks for
one after another, but a host with more than LANE_URLS of them gets several lanes. A URL that can't be had is a row with its error; it never fails the
others. Each hop is checked before it is requested, and the connection goes to the address that was checked. Bodies are read up to
a limit. What fails is tried again after a delay. A retried task repeats its requests, so write the rows before they are used.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import ssl
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from metaloom.functions.batches import pieces
from metaloom.functions.http import decoded, request_headers
from metaloom.functions.ship import ship
from metaloom.functions.urls import host_of, normalize_url, resolve

REDIRECTS = (301, 302, 303, 307, 308)
#: URLs that the data source takes as an option; URLs of one host that one task asks for.
MOST_LISTED, LANE_URLS = 100_000, 2_000
RESPONSE = "request_url string, status int, location string, content_type string, body string, bytes binary, retry_after string, error string"
PAGE = (
    "url string, final_url string, redirects array<struct<from:string,to:string,status:int>>, status int, content_type string, body string, bytes binary, retry_after string, error string, attempts int, "
    f"responses array<struct<{','.join(':'.join(f.split()) for f in RESPONSE.split(', '))}>>"
)
_READ = 1 << 16


@dataclass(frozen=True)
class Settings:
    """How requests are made; the defaults are those of a link preview."""

    timeout: float = 8.0
    most_redirects: int = 5
    most_bytes: int = 2_000_000
    retries: int = 1
    delay: float = 0.25
    pause: float = 0.0  # between two requests of one lane
    allow_local: bool = False
    allow_private: bool = False
    headers: dict[str, str] = field(default_factory=dict)


class Refused(Exception):
    """A request that wasn't made or an answer that doesn't count; its text is the row's error."""


def address_kind(text: str) -> str:
    """public, loopback, private, linkLocal or reserved."""
    a = ipaddress.ip_address(text.partition("%")[0])
    a = getattr(a, "ipv4_mapped", None) or a
    if a.is_loopback:
        return "loopback"
    if a.is_link_local:
        return "linkLocal"
    if a.version == 4 and any(a in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")) or a.version == 6 and a in ipaddress.ip_network("fc00::/7"):
        return "private"
    if a.is_unspecified or a.is_multicast or not a.is_global:
        return "reserved"
    return "public"


def _looked_up(host: str, port: int) -> list[str]:
    try:
        return [r[4][0] for r in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    except OSError:
        return []


def checked(url: str, settings: Settings, look_up: Callable[[str, int], list[str]] = _looked_up) -> str:
    """The address to connect to; raises Refused where a URL must not be requested. All of a name's addresses must be public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise Refused("Unsupported URL protocol")
    host = (parts.hostname or "").lower()
    name = host.removesuffix(".")
    if not settings.allow_local and (name == "localhost" or name.endswith(".localhost")):
        raise Refused("Localhost URLs are blocked by default.")
    addresses = look_up(host, parts.port or (443 if parts.scheme == "https" else 80))
    if not addresses:
        raise Refused(f"No address is known for {host}")
    for a in addresses:
        kind = address_kind(a)
        if kind == "loopback" and not settings.allow_local:
            raise Refused(f"Loopback address is blocked: {a}")
        if kind not in ("public", "loopback") and not settings.allow_private:
            raise Refused(f"Private or reserved network address is blocked: {a}")
    return addresses[0]


def requested(url: str, address: str, settings: Settings) -> dict:
    """The answer to one request, as a row of RESPONSE; redirects aren't followed, and their bodies aren't read."""
    parts = urlsplit(url)
    secure = parts.scheme == "https"
    made = http.client.HTTPSConnection if secure else http.client.HTTPConnection
    connection = made(parts.hostname, parts.port, timeout=settings.timeout)
    try:
        plain = socket.create_connection((address, connection.port), settings.timeout)  # the address that was checked
        connection.sock = ssl.create_default_context().wrap_socket(plain, server_hostname=parts.hostname) if secure else plain
        headers = request_headers(settings.headers) | {"accept-encoding": "gzip, deflate"}  # what can be read here
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
        answer = connection.getresponse()
        row = {"request_url": url, "status": answer.status, "location": answer.getheader("location"), "content_type": answer.getheader("content-type"), "retry_after": answer.getheader("retry-after"), "body": None, "bytes": None, "error": None}
        if answer.status not in REDIRECTS:
            row["bytes"] = _limited(answer, settings.most_bytes)
            row["body"] = decoded(row["bytes"], row["content_type"])
        return row
    finally:
        connection.close()


def _limited(answer: http.client.HTTPResponse, most: int) -> bytes:
    """The body, decompressed, up to the limit; neither more than it nor its compressed excess is held."""
    stated = answer.getheader("content-length") or ""
    too_large = Refused(f"Response body exceeds {most} bytes.")
    if stated.isdigit() and int(stated) > most:
        raise too_large
    coding = (answer.getheader("content-encoding") or "").lower()
    inflate = zlib.decompressobj(47) if coding in ("gzip", "deflate", "x-gzip") else None
    out = bytearray()
    while piece := answer.read(_READ):
        if not inflate:
            out += piece
        while inflate and piece and len(out) <= most:
            out += inflate.decompress(piece, most + 1 - len(out))
            piece = inflate.unconsumed_tail
        if len(out) > most:
            raise too_large
    return bytes(out)


def followed(url: str, settings: Settings, look_up: Callable = _looked_up) -> dict:
    """One try of a URL: where its redirects lead and what stands there."""
    row = dict.fromkeys(("final_url", "status", "content_type", "body", "bytes", "retry_after", "error")) | {"redirects": [], "responses": []}
    at = url
    try:
        for hop in range(settings.most_redirects + 1):
            address = checked(at, settings, look_up)
            try:
                answer = requested(at, address, settings)
            except (OSError, http.client.HTTPException, zlib.error, Refused) as e:
                said = str(e) if isinstance(e, Refused) else f"Request failed: {type(e).__name__}"
                row["responses"].append(dict.fromkeys(("status", "location", "content_type", "body", "bytes", "retry_after")) | {"request_url": at, "error": said})
                raise Refused(said) from e
            row["responses"].append(answer)
            if answer["status"] not in REDIRECTS:
                return row | {k: answer[k] for k in ("status", "content_type", "body", "bytes", "retry_after")} | {"final_url": at}
            if not answer["location"]:
                raise Refused(f"Redirect response from {at} did not include a Location header.")
            if hop == settings.most_redirects:
                raise Refused(f"Too many redirects. Maximum allowed redirects: {hop}.")
            to = resolve(answer["location"], at)
            if not to:
                raise Refused("Invalid or unsupported URL")
            row["redirects"].append({"from": at, "to": to, "status": answer["status"]})
            at = to
    except Refused as e:
        row["error"] = str(e)
    return row


def fetched(url: str | None, settings: Settings, look_up: Callable = _looked_up, wait: Callable[[float], None] = time.sleep) -> dict:
    """A row of PAGE: the first try without an error, else the last."""
    start = resolve(url) if url else None
    if not start:
        return dict.fromkeys(("final_url", "status", "content_type", "body", "bytes", "retry_after")) | {"url": url, "error": "Invalid or unsupported URL", "redirects": [], "responses": [], "attempts": 0}
    for attempt in range(settings.retries + 1):
        if attempt:
            wait(settings.delay)
        row = followed(start, settings, look_up)
        if row["error"] is None:
            break
    return row | {"url": url, "attempts": attempt + 1}


@dataclass
class Lane(InputPartition):
    urls: list[str]


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        given = json.loads(options.get("urls", "[]"))
        if len(given) > MOST_LISTED:
            raise ValueError(f"A list has {MOST_LISTED} URLs at most; use fetch_pages() for a table.")
        self.urls = [str(u) for u in given]
        kinds = Settings.__dataclass_fields__
        told = {k: json.loads(options[k.replace("_", "").lower()]) for k in kinds if k.replace("_", "").lower() in options}
        self.settings = Settings(**told)
        self.lane = int(options.get("laneurls", LANE_URLS))

    def partitions(self) -> list[Lane]:
        """The lanes of each host; small hosts share a lane."""
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault((urlsplit(resolve(u) or "").hostname or ""), []).append(u)
        lanes: list[list[str]] = []
        shared: list[str] = []
        for urls in sorted(hosts.values(), key=len, reverse=True):
            if len(urls) > self.lane // 2:
                lanes += [urls[i : i + self.lane] for i in range(0, len(urls), self.lane)]
                continue
            if len(shared) + len(urls) > self.lane:
                lanes.append(shared)
                shared = []
            shared = shared + urls
        return [Lane(x) for x in [*lanes, shared] if x]

    def read(self, partition: Lane) -> Iterator[pa.RecordBatch]:
        yield from _batches(iter(partition.urls), self.settings)


class HttpSource(DataSource):
    """Options: urls (a JSON list), the Settings by name without underscores (mostBytes, allowLocal ..., as JSON), and laneUrls."""

    @classmethod
    def name(cls) -> str:
        return "metaloom_http"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> HttpReader:
        return HttpReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(HttpSource)


_ANSWER = [(f.split()[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in RESPONSE.split(", ")]
_HOP = [("from", pa.string()), ("to", pa.string()), ("status", pa.int32())]
_PAGE = pa.schema(
    [("url", pa.string()), ("final_url", pa.string()), ("redirects", pa.list_(pa.struct(_HOP))), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.string()), ("bytes", pa.binary()), ("retry_after", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("responses", pa.list_(pa.struct(_ANSWER)))]
)


def _batches(urls: Iterator[str | None], settings: Settings) -> Iterator[pa.RecordBatch]:
    """A batch for each page, as pages can be large."""
    for n, url in enumerate(urls):
        if n and settings.pause:
            time.sleep(settings.pause)
        row = fetched(url, settings)
        yield pa.RecordBatch.from_pylist([{k: row[k] for k in _PAGE.names}], schema=_PAGE)


def fetch_pages(wanted: DataFrame, settings: Settings = Settings(), lanes: int = 64, lane_urls: int = LANE_URLS) -> DataFrame:  # noqa: B008
    """A row of PAGE for each distinct URL of wanted (url, more), requested by as many tasks as lanes says at the same time.

    Hosts are counted first, on URLs alone: one with more than lane_urls goes to several lanes by a hash of its URLs, any other to one.
    """
    ship(wanted.sparkSession)
    urls = wanted.select("url").distinct().withColumn("host", F.coalesce(host_of(normalize_url("url")), F.lit("")))
    sizes = urls.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    dealt = urls.join(sizes.hint("merge"), "host").withColumn("lane", F.pmod(F.xxhash64("url"), F.ceil(F.col("n") / lane_urls)))
    told = asdict(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (u for whole in batches for batch in pieces(whole, 1000) for u in batch.column("url").to_pylist())
        yield from _batches(asked, Settings(**told))

    return dealt.repartition(lanes, "host", "lane").select("url").mapInArrow(run, PAGE)


def responses_of(pages: DataFrame) -> DataFrame:
    """The answers of all hops of fetched pages, in the form that metaloom.operators.fetch replays; one of several for a URL counts there."""
    return pages.select(F.explode("responses").alias("r")).select("r.*")
