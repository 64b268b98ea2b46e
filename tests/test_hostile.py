"""No page may fail the pages beside it."""

import json
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from metaloom.functions.batches import pieces
from metaloom.operators import plugins
from metaloom.sources import pages

ODD = st.sampled_from(["\\ud800", "\\udc00", "\\ud83d\\ude00", "9" * 5000, "-1e999", "null", '"', "{", "}", "[", "]", ":", ",", "<", ">", "=", "'", "\x00", "\ufffe", "&#xD800;", "&#99999999999;", "\u0130", " ", "a", "title", "image", "width"])
SHAPES = ['<script type="application/ld+json">{}</script>', '<script type="application/json">{{"title":"{}","width":{}}}</script>', "<script>window.__INITIAL_STATE__={}</script>", '<img src="{}" width="{}" srcset="{}">', '<meta property="og:image" content="{}">', '<link rel="icon" href="{}">', "{}"]


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=12), st.sampled_from(SHAPES), st.sampled_from(["https://e.com/", "https://e.com:" + "1" * 5000, "http://[::1", "https://www.youtube.com/watch?v=%s", None, "\ud800"]))
def test_pages_are_read_and_fit_utf_8(parts, shape, url):
    html = shape.replace("{}", "".join(parts))
    page = pages.safe_page(url, html)
    if page:
        json.dumps(page, ensure_ascii=False).encode()


def test_a_page_that_cannot_be_read_costs_a_warning(spark, monkeypatch):
    bad = pages.unread("https://e.com/#x", ValueError("no"))
    assert bad["final_url"] == "https://e.com/" and bad["jsonld_warnings"] == ["Could not read page: ValueError"] and set(bad) == set(pages.COLUMNS)
    monkeypatch.setattr(pages, "elements", lambda html: 1 / 0)
    assert pages.safe_page("https://e.com/", "x")["jsonld_warnings"] == ["Could not read page: ZeroDivisionError"]
    assert pages.safe_page(None, "x") is None


def test_wanted_columns(spark):
    df = spark.createDataFrame([(1, "https://e.com/", "<title>t</title>"), (2, None, None)], "id int, url string, html string")
    found = pages.scan(df, ["title"])
    assert found.columns == ["id", "url", "title"] and sorted((r.id, r.title) for r in found.collect()) == [(1, "t"), (2, None)]
    assert [c for c in pages.scan(df).columns[2:]] == list(pages.COLUMNS)


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_pieces(rows):
    batch = pa.RecordBatch.from_pydict({"a": ["x" * n for n in (0, 5, 50, 3, 0, 60, 1)], "b": [None, "y", None, "z", None, "w", "q"]})
    parts = list(pieces(batch, rows, 20))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and all(p.num_rows <= rows for p in parts)
    assert all(p.num_rows == 1 or sum(map(len, p.column("a").to_pylist())) <= 20 for p in parts)
    assert list(pieces(batch.slice(0, 0), rows)) == []


@pytest.mark.parametrize("shape", ["<video>{}</p>", '<video src="/v{}.mp4"><source src="/s{}.mp4"></video>', '<audio src="/v{}.mp3"><source src="/s{}.mp3">', '<picture><img src="/a{}.png"></p>'])
def test_time_follows_the_page(shape):
    """Twice the page takes about twice the time, whatever stays open."""
    seconds = []
    for n in (4000, 16000):
        html = "".join(shape.replace("{}", str(i)) for i in range(n))
        began = time.process_time()
        pages.scan_page("https://e.example/", html)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 10 * max(seconds[0], 0.05)


def test_functions_of_plugins_fail_alone():
    page = {"url": "u", "n": 0}
    found = plugins.run((("Plugin extractor", "a", lambda p: {"title": str(1 // p["n"])}), ("Adapter", "b", lambda p: {"title": p["url"], "images": ("x",)}), ("Plugin extractor", "c", lambda p: None), ("Plugin extractor", "d", lambda p: {"title": "\ud800"}), ("Plugin extractor", "e", lambda p: [1])), page)
    assert [r["plugin"] for r in found["plugin_rows"]] == ["b"] and found["plugin_rows"][0]["images"] == ["x"]
    assert [w.split(" failed")[0] for w in found["plugin_warnings"]] == ['Plugin extractor "a"', 'Plugin extractor "d"', 'Plugin extractor "e"']
    json.dumps(found, ensure_ascii=False).encode()


def test_open_elements_without_anything_cost_no_resolving(monkeypatch):
    from metaloom.sources import media
    from metaloom.sources.pages import scan_page

    calls, resolve = [], media.resolve
    monkeypatch.setattr(media, "resolve", lambda *a: calls.append(a) or resolve(*a))
    page = scan_page("https://e.example.com/", "<video>" * 2000 + "<audio>" * 2000 + "</p>" * 2000 + '<video src="/a.mp4">', ("dom_videos", "dom_audio"))
    assert [v["url"] for v in page["dom_videos"]] == ["https://e.example.com/a.mp4"] and page["dom_audio"] == []
    assert len(calls) < 20
