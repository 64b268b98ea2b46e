import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from metaloom.functions import http, images, js, urls
from metaloom.sources import html, payload
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("url", "base", "wanted"),
    [
        ("HTTPS://Ex.COM:443/a#x", None, "https://ex.com/a"),
        ("http://ex.com:8080", None, "http://ex.com:8080/"),
        ("/c", "https://example.com/a/b", "https://example.com/c"),
        ("../c?x=1#f", "https://example.com/a/b/d", "https://example.com/a/c?x=1"),
        ("?q", "https://example.com/a/b", "https://example.com/a/b?q"),
        ("", "https://example.com/", None),
        ("//cdn.com/x", "http://example.com/", "http://cdn.com/x"),
        ("a b/é", "https://example.com/", "https://example.com/a%20b/%C3%A9"),
        ("https://user:p@ex.com/", None, "https://user:p@ex.com/"),
        ("http://0x7f.1/", None, "http://127.0.0.1/"),
        ("http://[::1]/", None, "http://[::1]/"),
        ("http:\\\\ex.com\\a", None, "http://ex.com/a"),
        ("javascript:x", "https://example.com/", None),
        ("http://ex.com:99999/", None, None),
        ("http://a b/", None, None),
        ("./", "https://example.com/a/b", "https://example.com/a/"),
        ("https://ex.com/%2e%2e/x", None, "https://ex.com/x"),
    ],
)
def test_resolve(url, base, wanted):
    assert urls.resolve(url, base) == wanted


@settings(max_examples=300, deadline=None)
@given(st.text("ab/.?#:%é \\@[]", max_size=30))
def test_resolving_is_idempotent(text):
    found = urls.resolve(text, "https://example.com/d/e")
    assert found is None or urls.resolve(found) == found


TEXTS = [None, "", " ", "a  b\n", "﻿x ", "12px", "-3.7e2x", "x1", " +5", "😀 é", ".5", "1.", "12.0 5", "\x1cq\x85"]


def test_columns_agree_with_their_twins(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows = df.select("i", js.squashed("t").alias("s"), js.integer_of(F.col("t")).alias("n"), js.number_of(F.col("t")).alias("f"), js.units(F.col("t")).alias("u")).collect()
    for r in rows:
        t = TEXTS[r.i]
        assert (r.s, r.n, r.f) == (js.squash(t), js.to_integer(t), js.to_number(t)), repr(t)
        assert r.u == (None if t is None else len(t.encode("utf-16-le")) // 2)


def test_two_places_round_the_binary_value(spark):
    rows = spark.createDataFrame([(i / 2,) for i in range(201)], "x double").select("x", js.two_places(F.col("x")).alias("y")).collect()
    assert all(f"{r.y:.2f}" == f"{r.x / 100:.2f}" or abs(r.x / 100 * 1000 % 10 - 5) < 1e-6 for r in rows) and {r.x: r.y for r in rows}[47.5] == 0.47


def test_markup():
    page = """<!-- <img src=no> --><IMG SRC=a.png alt='x > y' alt=second><textarea><img src=no></textarea><a title="<img src=no>">t</a>
    <meta content="a&amp;b&copy=1&ampx" name=d><script>"<img src=no>"</SCRIPT><video><source src=v></video><source src=w><title>A &lt; B &amp C</title>"""
    found = html.elements(page)
    assert [e.tag for e in found] == ["img", "textarea", "meta", "script", "video", "source", "source", "title"]
    assert found[0].attributes == {"src": "a.png", "alt": "x > y"}
    assert found[2].get("content") == "a&b&copy=1&ampx"
    assert found[5].owner is found[4] and found[6].owner is None
    assert found[7].text == "A < B & C"
    for broken in ("<", "<a", "<img src='", "<!--", "</", "<script>", "<title>x", "<!>", "<?x", "<img " + "=" * 50_000, "<a" * 50_000, "<!-->x<img>"):
        html.elements(broken)


def test_payload():
    nodes, warnings = payload.linked_data([("application/ld+json", '<!-- [{"@type":"A","@graph":[{"b":1},2]}] -->'), ("application/ld+json", "{NaN}"), ("text/plain", "{}")])
    assert [list(n) for n in nodes] == [["@type", "@graph"], ["b"]] and len(warnings) == 1
    items, _ = payload.embedded([("", None, 'x.__INITIAL_STATE__={"a":"}\\"{","b":[1]};'), ("", "__NEXT_DATA__", '{"p":1}'), ("", None, "ytInitialData = [1,2]")])
    assert [(s, p, d) for s, p, d in items] == [("nextData", None, {"p": 1}), ("initialState", "__INITIAL_STATE__", {"a": '}"{', "b": [1]}), ("youtubeInitialData", "ytInitialData", {"value": [1, 2]})]
    assert [k for _, k, _ in payload.walk({"b": 1, "10": 2, "9": {"c": [3]}})] == [None, "9", "c", None, "10", "b"]
    assert payload.text_of([{}, {"name": " n "}]) == "n" and payload.text_of({"@id": 5}) == "5" and payload.joined({"runs": [{"text": "a"}, {"text": "b"}]}) == "ab"
    deep = "[" * 3000 + "]" * 3000
    assert payload.embedded([("application/json", None, deep)])[0] == []


def test_picture_sizes():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 48, 64) + b"\x03\0\0\0"
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    vp8l = b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + (299 | 199 << 14).to_bytes(4, "little")
    assert [images.size_of(b, None) for b in (png, jpeg, vp8x, vp8l, b"", b"x" * 40, png[:20])] == [(640, 480), (64, 48), (100, 50), (300, 200), None, None, None]


def test_headers_and_bodies(spark):
    assert http.request_headers({"Accept": "x"})["accept"] == "x" and len(http.request_headers()) == 14
    assert http.decoded("é€".encode("cp1252"), 'text/html; charset="ISO-8859-1"') == "é€"
    assert http.decoded(b"\xef\xbb\xbfa\xff", "text/html; charset=nonsense") == "a\ufffd" and http.decoded(None, None) is None
    df = spark.createDataFrame([(bytearray("ü".encode("utf-16-le")), "t; charset=utf-16le"), (None, None)], "b binary, t string")
    assert [r[0] for r in df.select(http.decode_body("b", "t")).collect()] == ["ü", None]
