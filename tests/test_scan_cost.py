"""What a page costs: nothing is resolved, searched or walked more often than its content asks for."""

from metaloom.sources import media, pages, sites
from metaloom.sources.payload import LONGEST_KEY


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or real(*a, **k))
    return calls


def test_a_picture_is_resolved_once(monkeypatch):
    calls = counted(monkeypatch, media, "resolve")
    found = pages.scan_page("https://e.example.com/a", '<img src="/x.jpg" width="300"><img data-src="/y.jpg">', ("dom_images",))
    assert [a["url"] for a in found["dom_images"]] == ["https://e.example.com/x.jpg", "https://e.example.com/y.jpg"] and len(calls) == 2


def test_media_of_all_kinds_come_from_one_walk(monkeypatch):
    calls = counted(monkeypatch, media, "walk")
    long = "image" + "x" * LONGEST_KEY
    html = f'<script type="application/json">{{"image":"/a.jpg","videoUrl":"/b.mp4","podcastUrl":"/c.mp3","{long}":"/cover/d.png"}}</script>'
    found = pages.scan_page("https://e.example.com/a", html, ("json_images", "json_videos", "json_audio"))
    names = [[a["url"].rsplit("/", 1)[1] for a in found[c]] for c in ("json_images", "json_videos", "json_audio")]
    assert names == [["a.jpg", "d.png"], ["b.mp4"], ["c.mp3"]] and len(calls) == 1


def test_facts_of_a_site_come_from_one_walk(monkeypatch):
    calls = counted(monkeypatch, sites, "walk")
    facts = sites.site_facts("https://x.com/u/status/1", [], [("applicationJson", None, {"a": {"screen_name": "s"}, "tags": ["t"], "viewCount": "7 views"})])
    assert facts["person"]["name"] == "s" and facts["tags"] == ["t"] and facts["views"] == 7 and len(calls) == 1
