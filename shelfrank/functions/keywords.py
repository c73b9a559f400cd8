"""Many literal keywords in one reading of a text.

A list of a few keywords is one predicate each, inside generated code. Longer lists
become an Aho-Corasick automaton (``pyahocorasick``) that an Arrow function runs over
the lower-cased text: a text is read once, whatever the number of keywords. The list
is the caller's, so it is on the driver already; it is dealt to automata of at most
``AUTOMATON_CHARS`` characters (a node takes under 64 bytes, so 64 MB each at most).

Defined results: a null text counts as empty; an empty keyword is found in every text;
repeated keywords count once. Texts and keywords meet as they stand: callers lower-case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lists over this are matched by automaton; both ways find the same rows.
FEW_KEYWORDS = 32
AUTOMATON_CHARS = 1_000_000


def keyword_parts(keywords: Sequence[str], most: int | None = None) -> list[list[str]]:
    """Distinct non-empty keywords in order, in parts of at most ``most`` characters
    (a longer keyword is a part of its own)."""
    most = AUTOMATON_CHARS if most is None else most
    parts, size = [], 0
    for kw in dict.fromkeys(k for k in keywords if k):
        if not parts or size + len(kw) > most:
            parts.append([])
            size = 0
        parts[-1].append(kw)
        size += len(kw)
    return parts


def _automaton(keywords: Sequence[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for kw in keywords:
        a.add_word(kw, kw)
    a.make_automaton()
    return a


def _function(part: list[str], kind: str):
    from shelfrank.session import ship_package

    ship_package(None)

    def texts(batches: Iterator[pa.Array]) -> Iterator[tuple[object, list[str]]]:
        automaton = _automaton(part)  # once a task
        for b in batches:
            yield automaton, b.to_pylist()

    def any_hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a, rows in texts(batches):
            yield pa.array([t is not None and next(a.iter(t), None) is not None for t in rows], pa.bool_())

    def all_hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a, rows in texts(batches):
            yield pa.array([sorted({kw for _, kw in a.iter(t)}) if t else [] for t in rows], pa.list_(pa.string()))

    return F.arrow_udf(any_hit if kind == "boolean" else all_hits, kind)


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is a substring of ``text``."""
    if any(k == "" for k in keywords):
        return F.lit(True)
    hit = F.lit(False)
    for part in keyword_parts(keywords):
        hit = hit | _function(part, "boolean")(F.coalesce(text, F.lit("")))
    return hit


def contained(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that are substrings of ``text``, each once, in code-point order."""
    found = F.array(F.lit("")) if any(k == "" for k in keywords) else F.array().cast("array<string>")
    for part in keyword_parts(keywords):
        found = F.concat(found, _function(part, "array<string>")(F.coalesce(text, F.lit(""))))
    return F.array_sort(found)
