"""A small forgiving HTML reader: block elements as nodes, text in page order."""

from __future__ import annotations

import re
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Inside a tag: up to its end or to the value of the next attribute.
_STEP = re.compile(r"[^>=]*(=\s*)?")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
_SKIPPED = frozenset("script style noscript template svg iframe object title head math canvas".split())
_RAW = frozenset("script style noscript template iframe title svg math canvas object".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An opening tag that ends an open element of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Elements nested deeper become siblings, as in browsers.
MAX_DEPTH = 512
_HOLDS = frozenset("ul ol dl table body div section article main aside td blockquote form".split())

#: Tag groups (the last one: any other tag).
TAGS = ("body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "td", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "other")
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {"ol": 9, "dl": 9, "dd": 10, "dt": 10, "th": 12, "tr": 11, "tbody": 11, "h4": 8, "h5": 8, "h6": 8, "figcaption": 15, "menu": 16, "html": 0, "select": 20, "button": 20, "fieldset": 20, "textarea": 20, "dialog": 19}
#: Groups of words in class, id, role and label attributes.
ATTRIBUTE_WORDS = (
    frozenset("article content post entry story text body main prose page blog news".split()),
    frozenset("nav navigation menu breadcrumb breadcrumbs navbar tabs pagination pager toc links".split()),
    frozenset("header head masthead banner top logo branding hero tagline".split()),
    frozenset("footer foot copyright bottom legal colophon".split()),
    frozenset("sidebar side aside widget related recommended popular trending more rail complementary".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp affiliate".split()),
    frozenset("comment comments reply replies respond disqus discussion responses reader readers".split()),
    frozenset("cookie cookies notice consent alert modal popup overlay gdpr privacy warning message dialog paywall".split()),
    frozenset("form newsletter subscribe signup login search contact subscription register".split()),
    frozenset("share social sharing follow tags meta byline tools print".split()),
)
_GROUP_OF: dict[str, int] = {}
for _i, _words in enumerate(ATTRIBUTE_WORDS):
    for _w in _words:
        _GROUP_OF[_w] = _GROUP_OF.get(_w, 0) | 1 << _i


def attribute_groups(attributes: str) -> int:
    """Bits of the word groups that an opening tag's attributes name."""
    bits = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _WORD.findall(m[1] or m[2] or m[3] or ""):
            bits |= _GROUP_OF.get(w.lower(), 0)
    return bits


def plain_text(text: str) -> str:
    """``text`` with its character references decoded; numbers of any length."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return unescape(text)


class Tags:
    """The markup of a page from left to right, each character read a fixed number of times.

    Quotes hold a ``>`` only around an attribute's value. Where such a quote is never
    closed, tags end at the next ``>`` from there on, so no later tag looks for
    a closing quote again. ``<`` that starts no markup is text; an unfinished tag
    at the very end is dropped.
    """

    def __init__(self, html: str):
        self.html, self.end = html, len(html)
        self.last_open, self.last_close = html.rfind("<"), html.rfind(">")
        self.quotes = True

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """The next markup behind ``at``: its start and end, and for a tag its
        name, whether it closes and its attributes (else an empty name)."""
        html, end = self.html, self.end
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                stop = html.find("-->", at + 4)
                return at, stop + 3 if stop >= 0 else end, "", False, ""
            mark = html[at + 1 : at + 2]
            closing = mark == "/"
            if at > self.last_close:  # nothing ends any more
                if at == self.last_open and (closing or mark in "!?" or _NAME.match(mark)) and mark:
                    return at, end, "", False, ""
            elif mark in "!?":
                return at, html.find(">", at) + 1, "", False, ""
            elif name := _NAME.match(html, at + 1 + closing):
                stop = self._tag_end(name.end())
                return at, stop + 1, name[0].lower(), closing, html[name.end() : stop]
            at += 1
        return end, end, "", False, ""

    def _tag_end(self, start: int) -> int:
        html, at = self.html, start
        while self.quotes:
            step = _STEP.match(html, at)
            at = step.end()
            if at == self.end:
                self.quotes = False
            elif html[at] == ">":
                return at
            elif step[1] and html[at] in "\"'":
                at = html.find(html[at], at + 1) + 1
                self.quotes = at > 0
        return html.find(">", start)


class Page:
    """Nodes in page order (0: the page) and its text pieces.

    ``pieces``: (node, text, block): pieces of one block belong together."""

    __slots__ = ("parent", "tag", "groups", "depth", "last", "own", "links", "marks", "breaks", "pieces")

    def __init__(self, html: str):
        self.parent, self.tag, self.groups, self.depth, self.last = [-1], [0], [0], [0], [0]
        self.own, self.links, self.marks, self.breaks, self.pieces = [0], [0], [0], [0], []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, names = [0], ["html"]
        link, block, at, end = 0, 0, 0, len(html)
        tags, pieces = Tags(html), self.pieces

        def close(level: int) -> None:
            now = len(self.parent) - 1
            while len(stack) > level:
                self.last[stack.pop()] = now
                names.pop()

        while at < end:
            start, after, name, closing, attributes = tags.next(at)
            if start > at:
                text = html[at:start]
                if "&" in text:
                    text = plain_text(text)
                node = stack[-1]
                pieces.append((node, text, block))
                n = len(text) - text.count(" ")
                self.own[node] += n
                if link:
                    self.links[node] += n
                self.marks[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
            at = after
            if not name:
                continue
            if closing:
                if name == "a":
                    link = 0
                if name in _INLINE:
                    continue
                block += 1
                if name in names:
                    level = len(names) - 1 - names[::-1].index(name)
                    if level > 0:
                        close(level)
                        link = 0
                continue
            if name in _RAW:
                found = re.compile(f"</{re.escape(name)}\\s*>?", re.I).search(html, at)
                at = found.end() if found else end
                continue
            if name == "a":
                link = 1
            if name == "br":
                self.breaks[stack[-1]] += 1
                pieces.append((stack[-1], " ", block))
                continue
            if name in _INLINE or name in _VOID:
                if name == "hr":
                    block += 1
                continue
            block += 1
            if name in ("html", "body", "head"):
                if name == "body":
                    self.groups[0] |= attribute_groups(attributes) if attributes else 0
                continue
            ends = _ENDS.get(name)
            if names[-1] == "p" or (ends and names[-1] in ends):
                close(len(names) - 1)  # a block ends an open paragraph
            if ends and name != "p":
                for i in range(len(names) - 1, 0, -1):
                    if names[i] in ends:
                        close(i)
                        break
                    if names[i] in _HOLDS:
                        break
            if len(stack) >= MAX_DEPTH:
                close(MAX_DEPTH - 1)
            link = 0
            self.parent.append(stack[-1])
            self.tag.append(_TAG_OF.get(name, len(TAGS) - 1))
            self.groups.append(attribute_groups(attributes) if attributes else 0)
            self.depth.append(len(stack))
            node = len(self.parent) - 1
            self.last.append(node)
            for x in (self.own, self.links, self.marks, self.breaks):
                x.append(0)
            if not attributes.endswith("/"):
                stack.append(node)
                names.append(name)
        close(0)

    def text(self, inside) -> str:
        """Blocks of the nodes that ``inside`` holds, white space made single, one a line."""
        blocks, now = [], None
        for node, text, block in self.pieces:
            if inside[node]:
                if block == now:
                    blocks[-1].append(text)
                else:
                    blocks.append([text])
                    now = block
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)
