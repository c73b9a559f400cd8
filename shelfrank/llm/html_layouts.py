"""Pages put together from layout parts with known roles, to fit the node model on."""

from __future__ import annotations

import re

import numpy as np

from shelfrank.llm.html_dom import Page

_MARK = "\x01"  # first character of every piece of main text


class _Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.r.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, n: int) -> str:
        parts = ("ba", "re", "to", "lin", "ver", "sta", "o", "mi", "ent", "ka", "der", "su", "al", "ti", "on")
        return " ".join("".join(parts[i] for i in self.r.integers(len(parts), size=self.r.integers(1, 5))) for _ in range(max(1, n)))

    def sentences(self, n: int) -> str:
        out = []
        for _ in range(n):
            w = self.words(int(self.r.integers(1, 26))).capitalize()
            if self.chance(0.4):
                w = w.replace(" ", ", ", 1)
            out.append(w + self.pick(".", ".", ".", "!", "?"))
        return " ".join(out)

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(int(self.r.integers(1, 4)))}</a></li>' for i in range(n))

    def box(self, tag_options, class_options, inner: str, bare: float = 0.15) -> str:
        tag = self.pick(*tag_options)
        if self.chance(bare):
            return f"<{tag}>{inner}</{tag}>"
        name = self.pick(*class_options)
        attr = self.pick("class", "class", "id")
        extra = f' {self.pick("data-x", "style", "role")}="{self.words(1)}"' if self.chance(0.2) else ""
        return f'<{tag} {attr}="{name}"{extra}>{inner}</{tag}>'

    # parts that aren't main text
    def nav(self):
        return self.box(("nav", "nav", "div", "ul"), ("nav", "menu", "main-menu", "navigation", "navbar top", "breadcrumb"), f"<ul>{self.links(int(self.r.integers(1, 9)))}</ul>")

    def header(self):
        inner = f"<{self.pick('h1', 'h2', 'div', 'p')}>{self.words(3)}</{self.pick('h1', 'h2', 'div', 'p')}>" + (f"<p>{self.sentences(1)}</p>" if self.chance(0.5) else "")
        return self.box(("header", "header", "div"), ("header", "site-header", "masthead", "banner", "page-head"), inner + (self.nav() if self.chance(0.4) else ""), 0.3)

    def ad(self):
        inner = self.pick(self.sentences(int(self.r.integers(1, 4))), f"<p>{self.sentences(2)}</p>", f'<a href="/buy">{self.words(4)}</a>')
        return self.box(("div", "div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"), inner, 0.0)

    def footer(self):
        inner = "&copy; " + self.words(2) + " &middot; " + self.sentences(int(self.r.integers(1, 4)))
        if self.chance(0.4):
            inner = f"<p>{inner}</p><ul>{self.links(4)}</ul>"
        return self.box(("footer", "footer", "div"), ("footer", "site-footer", "copyright", "page-foot", "legal"), inner, 0.5 if self.chance(0.6) else 0.0)

    def sidebar(self):
        parts = [f"<h3>{self.words(2)}</h3><ul>{self.links(5)}</ul>", f"<p>{self.sentences(int(self.r.integers(1, 4)))}</p>", f"<h4>{self.words(2)}</h4><p>{self.sentences(2)}</p><a href='/'>{self.words(2)}</a>"]
        inner = "".join(self.pick(*parts) for _ in range(self.r.integers(1, 4)))
        return self.box(("aside", "aside", "div"), ("sidebar", "side", "widget", "related", "popular", "rail right", "recommended"), inner, 0.25)

    def comments(self):
        one = lambda: self.box(("div", "li", "article", "p"), ("comment", "reply", "comment-body"), f"<b>{self.words(1)}</b> <p>{self.sentences(int(self.r.integers(1, 5)))}</p>", 0.3)
        inner = f"<h3>{self.words(1)}</h3>" + "".join(one() for _ in range(self.r.integers(1, 6)))
        return self.box(("section", "div", "ol"), ("comments", "comment-list", "responses", "disqus", "reader-comments", "discussion"), inner, 0.0)

    def notice(self):
        inner = self.pick(self.sentences(2), f"<p>{self.sentences(2)}</p><button>{self.words(1)}</button>")
        return self.box(("div", "div", "section", "aside"), ("cookie-banner", "notice", "consent", "alert", "gdpr popup", "privacy-notice", "modal", "warning message"), inner, 0.0)

    def form(self):
        inner = f"<label>{self.words(2)}</label><input name='q'><button>{self.words(1)}</button>" + (f"<p>{self.sentences(1)}</p>" if self.chance(0.6) else "")
        return f"<form{self.pick('', ' class=search', ' class=newsletter', ' id=login')}>{inner}</form>" if self.chance(0.7) else self.box(("div", "section"), ("newsletter", "subscribe", "signup", "login-form"), inner, 0.0)

    def share(self):
        return self.box(("div", "ul"), ("share", "social", "tags", "sharing tools"), self.links(3) if self.chance(0.5) else self.words(3), 0.0)

    # main text
    def paragraph(self):
        text = _MARK + self.sentences(int(self.r.integers(1, 12)))
        if self.chance(0.2):
            text = text.replace(" ", f' <a href="/x">{self.words(2)}</a> ', 1)
        if self.chance(0.15):
            return f"<p><b>{text}{self.pick('</b>', '')}<br>"
        return f"<p>{text}{self.pick('</p>', '</p>', '</p>', '')}"

    def piece(self):
        kind = self.r.random()
        if kind < 0.75:
            return self.paragraph()
        if kind < 0.83:
            return f"<h2>{_MARK}{self.words(4)}</h2>{self.paragraph()}"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{_MARK}{self.sentences(1)}</li>" for _ in range(self.r.integers(2, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{_MARK}{self.sentences(2)}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{_MARK}{self.words(2)}</td><td>{_MARK}{self.words(3)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f"<figure><img src='x.png'><figcaption>{_MARK}{self.sentences(1)}</figcaption></figure>"
        return f"<div>{_MARK}{self.sentences(3)}</div>"

    def body_text(self):
        title = self.words(6).capitalize()
        parts = [f"<h1>{_MARK}{title}</h1>"] if self.chance(0.85) else []
        for _ in range(self.r.integers(1, self.pick(3, 8, 25))):
            parts.append(self.piece())
            if self.chance(0.07):
                parts.append(self.pick(self.ad, self.share, self.notice, self.sidebar, self.form)())
        if self.chance(0.2):
            parts = ["<section>" + "".join(parts) + "</section>"]
        return "".join(parts)

    def page(self) -> str:
        kind = self.r.random()
        text = self.body_text()
        if kind < 0.45:
            main = f"<article{self.pick('', '', ' class=post', ' id=content')}>{text}</article>"
        elif kind < 0.6:
            main = f"<main{self.pick('', ' id=main')}>{text}</main>"
        elif kind < 0.9:
            main = self.box(("div", "div", "section", "td"), ("content", "post-body", "entry-content", "article", "story", "main-text", "prose"), text, 0.25)
        else:
            main = text  # right in the page
        if self.chance(0.2) and kind < 0.45:
            main = f"<main>{main}</main>"
        if self.chance(0.35):
            main += self.comments()
        if self.chance(0.3):
            main = main + self.sidebar() if self.chance(0.6) else self.sidebar() + main
        if self.chance(0.3):
            main = f'<div{self.pick("", " class=wrapper", " id=page", " class=container")}>{main}</div>'
        before = [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.75), (self.ad, 0.5), (self.form, 0.15)) if self.chance(p)]
        after = [f() for f, p in ((self.share, 0.15), (self.sidebar, 0.2), (self.comments, 0.1), (self.form, 0.15), (self.ad, 0.2), (self.footer, 0.8), (self.notice, 0.15)) if self.chance(p)]
        html = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><script>var a='</p>';</script></head><body>" + "".join(before) + main + "".join(after)
        if self.chance(0.15):
            html = html[: int(len(html) * self.r.uniform(0.5, 1))]
            return re.sub(r"<[^>]*$", "", html)
        return html + "</body></html>"


def training_pages(n: int, seed: int = 11) -> tuple[list[Page], list[np.ndarray]]:
    """Pages and, for each of their nodes, whether it holds main text."""
    maker, pages, labels = _Maker(seed), [], []
    for _ in range(n):
        page = Page(maker.page())
        y = np.zeros(len(page.parent), bool)
        for node, text, _block in page.pieces:
            y[node] |= _MARK in text
        # what lies between main text and main text is main text: a list around its items, the region's root
        below, children = y.copy(), np.zeros(len(y), int)
        for i in range(len(y) - 1, 0, -1):
            if below[i]:
                below[page.parent[i]] = True
                children[page.parent[i]] += 1
        total = sum(1 for _, t, _b in page.pieces if _MARK in t)
        held = np.zeros(len(y) + 1, int)
        for node, text, _block in page.pieces:
            held[node] += _MARK in text
        inside = np.concatenate([[0], np.cumsum(held[:-1])])
        for i in range(len(y)):
            mine = inside[page.last[i] + 1] - inside[i]
            alone = not any(below[k] and inside[page.last[k] + 1] - inside[k] == mine for k in range(i + 1, page.last[i] + 1)) if below[i] else False
            y[i] |= bool(below[i]) and (mine < total or alone) and mine > 0
        pages.append(page)
        labels.append(y)
    return pages, labels
