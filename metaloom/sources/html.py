"""One pass over a page's markup: the elements that metadata can stand in, with attributes as a browser reads them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

#: Elements whose content is text; noscript counts as one, and its content is read again as a fallback.
_RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "noscript")
_OWNERS = ("video", "audio", "picture")
_WANTED = frozenset(("meta", "link", "img", "source", "video", "audio", "picture", *_RAW))
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)|(/))")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+(>|$)""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_COMMENT_END = re.compile(r"--!?>|$")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    text: str = ""
    inside: str = ""  # the nearest open video, audio or picture
    owner: Element | None = field(default=None, repr=False)

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)


def attribute_text(raw: str) -> str:
    """Character references in an attribute: a name without semicolon that a letter, digit or = follows stays."""
    if "&" not in raw:
        return raw

    def one(m: re.Match) -> str:
        name = m[0]
        if name.endswith(";") or name[1] == "#":
            if name[1] == "#" or name[1:] in html5:
                return unescape(name)
        elif name[1:] in html5 and raw[m.end() : m.end() + 1] != "=":
            return unescape(name)
        return name

    return _ENTITY.sub(one, raw)


def _attributes(raw: str) -> dict[str, str]:
    """The first of equal names counts."""
    found: dict[str, str] = {}
    if not raw:
        return found
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        value = double or single or bare
        found.setdefault(name.lower(), attribute_text(value) if "&" in value else value)
    return found


def elements(html: str) -> list[Element]:
    """Wanted elements in document order."""
    out: list[Element] = []
    open_: list[Element] = []
    held = dict.fromkeys(_OWNERS, 0)  # open elements by name, so that a closing tag of none costs nothing
    at = 0
    while m := _OPEN.search(html, at):
        if m[1]:
            start = m.end() - 2 if html.startswith(">", m.end()) else m.end()
            at = _COMMENT_END.search(html, start).end() if not html.startswith((">", "->"), m.end()) else html.index(">", m.end()) + 1
            continue
        if m[2] or m[5]:
            at = html.find(">", m.end()) + 1 or len(html)
            continue
        rest = _REST.match(html, m.end())
        at = max(rest.end(), m.end()) if rest else len(html)
        tag = m[4].lower()
        if m[3]:
            if held.get(tag):
                while True:
                    last = open_.pop().tag
                    held[last] -= 1
                    if last == tag:
                        break
            continue
        if tag not in _WANTED:
            continue
        e = Element(tag, _attributes(html[m.end() : rest.start(1) if rest else at]), "", open_[-1].tag if open_ else "", open_[-1] if open_ else None)
        out.append(e)
        if tag in _ENDS:
            end = _ENDS[tag].search(html, at)
            stop = end.start() if end else len(html)
            e.text = html[at:stop]
            if tag in ("title", "textarea"):
                e.text = unescape(e.text)
            at = stop
        elif tag in _OWNERS:
            open_.append(e)
            held[tag] += 1
    return out
