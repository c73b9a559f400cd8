"""Operator 1: main text by gradient-boosted trees over DOM-node features.

A boosted ensemble gives each block element the chance that it belongs to the
main text, from its subtree's text and link density, its tag and attribute
words, its ancestors', its depth and its siblings. The decoding picks the best
consistent choice for the whole tree: above the text, inside it, or dropped;
nothing below a dropped node is taken, and below an inside node there are only
inside and dropped ones.

The trees are fitted on pages that are put together here from layout parts with
known roles, ``TRAINING_PAGES`` of them, so the fit doesn't grow with the table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready
from shelfrank.llm.html_dom import ATTRIBUTE_WORDS, TAGS, Page

#: Size of the fit: pages, trees, splits a tree, bins a feature.
TRAINING_PAGES, TREES, DEPTH, BINS = 600, 50, 4, 24
RATE, SHRINK = 0.25, 2.0
#: Cost of starting a region of text and of dropping a part of it.
START, DROP = 1.0, 1.0
#: Html characters whose nodes are scored together.
CHUNK = 4 << 20


def node_features(pages: list[Page]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Feature rows of all nodes of some pages, and the tree's arrays over them."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    page = np.repeat(np.arange(len(pages)), sizes)
    base = first[page]

    def flat(name):
        return np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])

    parent, tag, groups, depth, last = flat("parent"), flat("tag"), flat("groups"), flat("depth"), flat("last") + base
    own, links, marks, breaks = (flat(x).astype(float) for x in ("own", "links", "marks", "breaks"))
    n = len(parent)
    top = parent < 0
    parent = np.where(top, np.arange(n), parent + base)

    def subtree(x):
        c = np.concatenate([[0.0], np.cumsum(x)])
        return c[last + 1] - c[np.arange(n)]

    chars, linked, marked, nodes = subtree(own), subtree(links), subtree(marks), subtree(np.ones(n))
    is_p = (tag == TAGS.index("p")).astype(float)
    paragraphs = subtree(is_p)
    p_chars = subtree(own * is_p)
    whole = np.maximum(1, chars[base])
    before = np.concatenate([[0.0], np.cumsum(own)])[np.arange(n)] - np.concatenate([[0.0], np.cumsum(own)])[base]
    weight = (~top).astype(float)
    siblings = np.bincount(parent, weight, n)[parent] * weight
    sibling_chars = np.bincount(parent, chars * weight, n)[parent] * weight
    order = np.zeros(n)
    by_parent = np.argsort(parent, kind="stable")
    run = np.concatenate([[True], parent[by_parent][1:] != parent[by_parent][:-1]])
    start = np.maximum.accumulate(np.where(run, np.arange(n), 0))
    order[by_parent] = np.arange(n) - start
    children = np.bincount(parent, weight, n)
    nested = groups | (1 << (20 + tag))  # groups and tags of the node, then of all above it
    above = np.zeros(n, np.int64)
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        above[at] = above[parent[at]] | nested[parent[at]]
    columns = [
        depth, np.log1p(own), np.log1p(chars), linked / np.maximum(1, chars), links / np.maximum(1, own), nodes / (chars + 1), np.log1p(nodes),
        marked / (chars + 1), marks / (own + 1), np.log1p(paragraphs), p_chars / np.maximum(1, chars), chars / whole, before / whole, siblings,
        order / np.maximum(1, siblings), chars / np.maximum(1, sibling_chars), children, own / np.maximum(1, chars), breaks, chars / np.maximum(1, nodes),
        chars[parent] / whole, linked[parent] / np.maximum(1, chars[parent]), np.log1p(paragraphs[parent]),
    ]
    columns += [tag == i for i in range(len(TAGS))]
    columns += [(groups >> i) & 1 for i in range(len(ATTRIBUTE_WORDS))]
    columns += [(above >> i) & 1 for i in range(len(ATTRIBUTE_WORDS))]
    columns += [(above >> (20 + TAGS.index(t))) & 1 for t in ("article", "main", "section", "nav", "header", "footer", "aside", "form", "li", "td", "blockquote", "table")]
    columns += [tag[parent] == TAGS.index(t) for t in ("body", "div", "article", "section")]
    x = np.column_stack([np.asarray(c, np.float32) for c in columns])
    return x, {"parent": parent, "depth": depth, "last": last, "own": own, "top": top, "first": first, "sizes": sizes}


class Trees:
    """Boosted trees for a binary outcome; a tree asks the same question at each depth."""

    def __init__(self, base: float, features: np.ndarray, limits: np.ndarray, leaves: np.ndarray):
        self.base, self.features, self.limits, self.leaves = base, features, limits, leaves

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        columns = {f: np.ascontiguousarray(x[:, f]) for f in set(self.features.ravel().tolist())}
        for fs, ls, leaf in zip(self.features, self.limits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for f, v in zip(fs, ls, strict=True):
                at = at * 2 + (columns[f] > v)
            out += leaf[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton boosting on binned features; each depth takes the split of most gain over all its leaves."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # bin b: value <= cuts[b]
    rate = y.mean()
    base = float(np.log(rate / (1 - rate)))
    score = np.full(len(y), base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        fs, ls = [], []
        for d in range(depth):
            best = (-1.0, 0, 0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                slot = at * k + bins[j]
                gs = np.bincount(slot, g, k << d).reshape(-1, k).cumsum(1)
                hs = np.bincount(slot, h, k << d).reshape(-1, k).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK)).sum(0)[:-1]
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, i)
            _, j, i = best
            fs.append(j)
            ls.append(cuts[j][i])
            at = at * 2 + (bins[j] > i)
        leaf = RATE * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + SHRINK)
        score += leaf[at]
        features.append(fs)
        limits.append(ls)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(limits, np.float32), np.array(leaves))


def decode_tree(odds: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Nodes inside the text, by the best consistent choice of out, inside and dropped."""
    n = len(odds)
    weight = 1 + np.log1p(t["own"]) / 2
    yes, no = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight
    c = np.concatenate([[0.0], np.cumsum(no)])
    dropped = c[t["last"] + 1] - c[np.arange(n)]
    inside, out = yes.copy(), no.copy()
    levels = [np.flatnonzero(t["depth"] == d) for d in range(int(t["depth"].max(initial=0)) + 1)]
    for at in reversed(levels[1:]):
        up = t["parent"][at]
        np.add.at(inside, up, np.maximum(inside[at], dropped[at] - DROP))
        np.add.at(out, up, np.maximum(out[at], inside[at] - START))
    state = np.zeros(n, np.int8)  # 0 out, 1 inside, 2 dropped
    state[t["top"]] = inside[t["top"]] - START > out[t["top"]]
    for at in levels[1:]:
        up = state[t["parent"][at]]
        state[at] = np.where(up == 0, inside[at] - START > out[at], np.where(up == 1, np.where(inside[at] >= dropped[at] - DROP, 1, 2), 2))
    return state == 1


def extract_pages(htmls: list[str | None], model: Trees) -> list[str]:
    """Main texts of some pages, scored together."""
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    x, t = node_features(pages)
    inside = decode_tree(model.log_odds(x), t).tolist()
    return [p.text(inside[a : a + n]) for p, a, n in zip(pages, t["first"].tolist(), t["sizes"].tolist(), strict=True)]


@functools.cache
def trained_model() -> Trees:
    from shelfrank.llm.html_layouts import training_pages

    pages, labels = training_pages(TRAINING_PAGES)
    x, _ = node_features(pages)
    return fit_trees(x, np.concatenate(labels).astype(float))


def extract_text(pages: DataFrame, *, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",), model: Trees | None = None) -> DataFrame:
    """``key``, the ``keep`` columns and ``text`` for every row; no shuffle.

    Null and empty html give an empty text, as do pages without main text;
    repeated rows are read each; other columns are not read; an empty table gives
    an empty result.
    """
    model = model or trained_model()
    slim = python_ready(pages.select(F.col(key), *[F.col(c) for c in keep], F.col(html).alias("h_html")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chunk, size = [], [], 0
            for h in b.column(b.num_columns - 1):
                chunk.append(h.as_py())
                size += len(chunk[-1] or "")
                if size > CHUNK:
                    texts += extract_pages(chunk, model)
                    chunk, size = [], 0
            texts += extract_pages(chunk, model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return slim.mapInArrow(run, schema)
