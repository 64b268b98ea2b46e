"""Live requests against a server of this process, and the same answers replayed."""

import gzip
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from metaloom.operators import fetch
from metaloom.sources import live

ASKED: Counter = Counter()


class Site(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def do_GET(self):
        ASKED[self.path] += 1
        status, headers, body = 200, {"content-type": "text/html; charset=iso-8859-1"}, "<title>caf\xe9</title>".encode("latin-1")
        if self.path.startswith("/hop"):
            k = int(self.path[4:])
            status, headers, body = 302, {"location": f"/hop{k - 1}" if k else "/end"}, b""
        elif self.path == "/cycle":
            status, headers = 301, {"location": "/cycle"}
        elif self.path == "/lost":
            status = 307
        elif self.path == "/inside":
            status, headers = 302, {"location": "http://10.0.0.1/secret"}
        elif self.path == "/large":
            body = b"x" * 5000
        elif self.path == "/bomb":
            body, headers = gzip.compress(b"x" * 5_000_000), headers | {"content-encoding": "gzip"}
        elif self.path == "/zipped":
            body, headers = gzip.compress("<p>été".encode()), {"content-type": "text/html", "content-encoding": "gzip"}
        elif self.path == "/busy":
            status, headers = 429, headers | {"retry-after": "120"}
        elif self.path == "/flaky" and ASKED[self.path] == 1:
            self.close_connection = True
            return
        elif self.path == "/broken":
            self.close_connection = True
            return
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("content-length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


PATHS = ["/end", "/hop0", "/hop3", "/hop9", "/cycle", "/lost", "/inside", "/large", "/bomb", "/zipped", "/busy", "/broken"]


def test_the_source_equals_the_replay(spark, site, tmp_path):
    live.register(spark)
    urls = [site + p for p in PATHS] + ["mailto:x", "http://localhost:1/", ""]
    read = spark.read.format("metaloom_http").options(urls=json.dumps(urls), allowLocal="true", mostBytes="3000", delay="0.01", laneUrls="4").load()
    assert read.rdd.getNumPartitions() == 4  # three lanes of the site, one that the others share
    read.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    found = {r.url: r for r in pages.collect()}
    assert len(found) == len(urls)
    end, deep = found[f"{site}/end"], found[f"{site}/hop3"]
    assert (end.status, end.body, end.bytes, end.attempts, end.error) == (200, "<title>café</title>", "<title>café</title>".encode("latin-1"), 1, None)
    assert deep.final_url == end.final_url and [h.status for h in deep.redirects] == [302] * 4 and len(deep.responses) == 5
    assert found[f"{site}/zipped"].body == "<p>été" and found[f"{site}/busy"].retry_after == "120"
    assert {p: found[site + p].error for p in PATHS if found[site + p].error} == {
        "/hop9": "Too many redirects. Maximum allowed redirects: 5.", "/cycle": "Too many redirects. Maximum allowed redirects: 5.", "/lost": f"Redirect response from {site}/lost did not include a Location header.",
        "/inside": "Private or reserved network address is blocked: 10.0.0.1", "/large": "Response body exceeds 3000 bytes.", "/bomb": "Response body exceeds 3000 bytes.", "/broken": "Request failed: RemoteDisconnected",
    }
    assert found["mailto:x"].error == found[""].error == "Invalid or unsupported URL" and found[f"{site}/broken"].attempts == 2
    wanted = pages.select("url")
    columns = ["url", "final_url", "redirects", "status", "content_type", "body", "bytes", "retry_after", "error"]
    replayed = fetch.follow(wanted.where("url <> 'http://localhost:1/'"), live.responses_of(pages), allow_local=True).select(*columns)
    assert sorted(map(tuple, replayed.collect()), key=str) == sorted((tuple(r[c] for c in columns) for u, r in found.items() if u != "http://localhost:1/"), key=str)


def test_what_fails_is_tried_again(spark, site):
    waited = []
    row = live.fetched(f"{site}/flaky", live.Settings(allow_local=True, delay=0.5), wait=waited.append)
    assert row["status"] == 200 and row["attempts"] == 2 and waited == [0.5]
    row = live.fetched(f"{site}/broken", live.Settings(allow_local=True, retries=3), wait=waited.append)
    assert row["attempts"] == 4 and len(waited) == 4 and row["error"] == "Request failed: RemoteDisconnected"


def test_a_table_of_urls(spark, site):
    before = ASKED["/end"]
    wanted = spark.createDataFrame([(f"{site}/end", 1), (f"{site}/end", 2), (f"{site}/hop1", 3), ("http://10.1.2.3/x", 4), (None, 5)], "url string, n int")
    found = {r.url: (r.status, r.error) for r in live.fetch_pages(wanted, live.Settings(allow_local=True, retries=0), lanes=3, lane_urls=1).collect()}
    assert found == {f"{site}/end": (200, None), f"{site}/hop1": (200, None), "http://10.1.2.3/x": (None, "Private or reserved network address is blocked: 10.1.2.3"), None: (None, "Invalid or unsupported URL")}
    assert ASKED["/end"] == before + 2  # once for itself and once as the end of /hop1
    assert live.fetch_pages(wanted.limit(0)).count() == 0


def test_addresses():
    look_up = {"two.example": ["93.184.216.34", "127.0.0.1"], "good.example": ["93.184.216.34"], "six.example": ["::ffff:10.0.0.1"]}.get
    check = lambda url, **s: live.checked(url, live.Settings(**s), lambda host, port: look_up(host, []))
    assert check("http://good.example/") == "93.184.216.34"
    for url, why in (("http://two.example/", "Loopback address is blocked: 127.0.0.1"), ("http://six.example/", "Private or reserved network address is blocked: ::ffff:10.0.0.1"), ("http://none.example/", "No address is known for none.example"), ("http://a.localhost./", "Localhost URLs are blocked by default."), ("ftp://good.example/", "Unsupported URL protocol")):
        with pytest.raises(live.Refused, match=why.replace(".", r"\.")):
            check(url)
    kinds = {"127.0.0.1": "loopback", "::1": "loopback", "10.2.3.4": "private", "172.31.0.1": "private", "172.32.0.1": "public", "192.168.1.1": "private", "169.254.1.1": "linkLocal", "fe80::1": "linkLocal", "fd00::1": "private", "0.0.0.0": "reserved", "100.64.0.1": "reserved", "224.0.0.1": "reserved", "198.18.0.1": "reserved", "8.8.8.8": "public", "2606:4700::1111": "public"}
    assert {a: live.address_kind(a) for a in kinds} == kinds


def test_a_list_has_a_bound():
    with pytest.raises(ValueError, match="fetch_pages"):
        live.HttpReader({"urls": json.dumps(["http://a.example/"] * (live.MOST_LISTED + 1))})
