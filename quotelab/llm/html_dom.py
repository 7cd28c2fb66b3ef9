"""HTML as a flat tree of block elements and runs of text, without recursion and whatever the nesting.

Elements that only mark text (``b``, ``a``, ``span`` ...) are no nodes; their text belongs to the block around them, and a
run of text ends where a block begins or ends. Head, scripts, styles and other text that a page does not show are left out.
End tags that HTML lets a page omit are supplied, and what is missing at its end is closed.
"""
from __future__ import annotations

import re
from html import unescape

# Fixed values of HTML: elements that mark text within a block, that have no content, and whose content is not text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg math object select canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that end where one of the second kind begins, unless one of the third lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An end tag does not reach out of these.
SCOPES = frozenset("html body table td th article section main aside nav form".split())

_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z))", re.S)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)|\Z", re.I) for name in [*RAW, "head"]}
_BLANK = re.compile(r"\s*\Z")


class Page:
    """Nodes in page order: ``parent`` (-1 for the root), ``tag`` ("#text" for a run), ``attributes``, and of runs ``text`` and ``linked`` (characters in links)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.attributes, self.text, self.linked = [-1], ["html"], [""], [""], [0]
        self._stack, self._parts, self._links, self._anchor = [0], [], 0, False
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            self._take(html[at:m.start()])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                self._open(name, m[3] or "")
                if name in RAW and not m[0].endswith("/>"):
                    at = _RAW_END[name].search(html, at).end()
            elif m[1]:
                self._close(m[1].lower())
        self._take(html[at:])
        self._flush()

    def _take(self, text: str) -> None:
        if text:
            if "&" in text:
                text = unescape(text)
            self._parts.append(text)
            if self._anchor:
                self._links += len(text)

    def _flush(self) -> None:
        words = "".join(self._parts).split()
        if words:
            self._add("#text", "", " ".join(words), self._links)
        self._parts, self._links = [], 0

    def _add(self, tag: str, attributes: str = "", text: str = "", linked: int = 0) -> int:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _open(self, name: str, attributes: str) -> None:
        if name in INLINE:
            self._anchor = self._anchor or name == "a"
            return
        if name in VOID:
            if name == "br":
                self._parts.append("\n")
            elif name == "hr":
                self._flush()
            return
        if name == "html":
            return
        if name in RAW:  # nothing of it is shown here; what is around it is one run
            self._parts.append(" ")
            return
        self._flush()
        self._anchor = False
        if name in IMPLIED:
            self._end_implied(*IMPLIED[name])
        elif self.tag[self._stack[-1]] == "p" or self.tag[self._stack[-1]] in HEADINGS & {name}:
            self._stack.pop()
        self._stack.append(self._add(name, attributes))

    def _end_implied(self, ends: set[str], stop: set[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in stop:
                return
            if tag in ends:
                del self._stack[k:]
                if ends != {"tr", "td", "th"} and ends != {"thead", "tbody", "tr", "td", "th"}:
                    return

    def _close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self._anchor = False
            return
        if name in ("br", "p") and not any(self.tag[k] == name for k in self._stack):
            self._flush() if name == "p" else self._parts.append("\n")
            return
        if name in ("html", "body"):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag == name or (name in HEADINGS and tag in HEADINGS):
                self._flush()
                self._anchor = False
                del self._stack[k:]
                return
            if tag in SCOPES and name not in SCOPES and not (name == "div" and tag in ("section", "form")):
                return
