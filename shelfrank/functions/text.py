"""Column expressions for product texts, labels, keywords, slugs and judge output.

All functions return ``Column`` expressions that stay inside the JVM
(whole-stage codegen where Spark supports it); only long keyword lists are matched
by an Arrow function (:mod:`shelfrank.functions.keywords`).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.keywords import FEW_KEYWORDS, contains_any

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- fixed values (must equal the source behaviour for equal results) -------
# Encoder prefixes (E5 style), the placeholder for a product without parts,
# the default slug names and the judge's fallbacks.
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "
UNKNOWN_PRODUCT = "UNKNOWN_PRODUCT"
DEFAULT_SLUG = "query"
DEFAULT_JUDGE_SLUG = "no_query"
JUDGE_SLUG_MAX = 40
UNKNOWN_WINNER = "unknown"
UNIQUE_KEY_SEPARATOR = " / "
# Default keywords of the category-tagging report (matched as regular expressions).
DEFAULT_TAG_KEYWORDS = ("vibrator", "dildo", "erotik", "sextoy", "penispumpe", "buttplug")
# Catalog sample size the interactive search used by default (ours: opt-in).
REFERENCE_SEARCH_MAX_PRODUCTS = 100_000
# A judge answer fenced in three backticks (optional "json" tag), case-insensitive,
# dot matching newlines; group 1 runs greedily to the last closing fence.
CODE_FENCE_PATTERN = r"(?is)```(?:json)?\s*(.*)```"
CODE_FENCE = "```"
# ---------------------------------------------------------------------------

# Unicode-aware strip: Python's str.strip() removes every Unicode blank, Spark's
# trim only ASCII spaces (so a tab or NBSP at the ends would survive).
_USTRIP = r"(?U)^\s+|\s+$"


def ustrip(c: ColumnOrName) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(_c(c), _USTRIP, "")


def relevance_label(selects: ColumnOrName) -> Column:
    """1 if selected at least once, else 0; a null count is 0."""
    return F.coalesce(_c(selects) > 0, F.lit(False)).cast("int")


def _blank(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c), F.lit(""))


PRODUCT_TEXT_VARIANTS = ("judged", "explore", "catalog", "search", "search_safe")


def product_text(
    variant: str,
    name: ColumnOrName = "ProductName",
    brand: ColumnOrName = "BrandName",
    group: ColumnOrName = "Level4_ProductGroup",
    ptype: ColumnOrName = "ProductType",
) -> Column:
    """The five product-text variants.

    ``judged``  name brand group type, nulls as "", Unicode-stripped
    ``explore`` same parts and order, not stripped
    ``catalog`` name brand type group, nulls as "", stripped
    ``search``  non-null name, brand, then group or else type; UNKNOWN_PRODUCT if all null
    ``search_safe`` non-null name, brand, type, group; UNKNOWN_PRODUCT if all null
    """
    n, b, g, t = _c(name), _c(brand), _c(group), _c(ptype)
    if variant == "judged":
        return ustrip(F.concat_ws(" ", _blank(n), _blank(b), _blank(g), _blank(t)))
    if variant == "explore":
        return F.concat_ws(" ", _blank(n), _blank(b), _blank(g), _blank(t))
    if variant == "catalog":
        return ustrip(F.concat_ws(" ", _blank(n), _blank(b), _blank(t), _blank(g)))
    if variant == "search":
        parts = [n, b, F.coalesce(g, t)]
    elif variant == "search_safe":
        parts = [n, b, t, g]
    else:
        raise ValueError(f"unknown product text variant {variant!r}; expected one of {PRODUCT_TEXT_VARIANTS}")
    all_null = F.coalesce(*parts).isNull()
    # concat_ws skips nulls and keeps empty strings, like the part list it replaces.
    return F.when(all_null, F.lit(UNKNOWN_PRODUCT)).otherwise(F.concat_ws(" ", *parts))


def unique_product_key(
    name: ColumnOrName = "ProductName", brand: ColumnOrName = "BrandName", ptype: ColumnOrName = "ProductType"
) -> Column:
    """name / brand / type with nulls as "" (values containing ' / ' can collide, as in the source)."""
    return F.concat_ws(UNIQUE_KEY_SEPARATOR, _blank(name), _blank(brand), _blank(ptype))


def with_prefix(prefix: str, c: ColumnOrName) -> Column:
    """Encoder prefix such as ``query: ``; a null text counts as empty."""
    return F.concat(F.lit(prefix), _blank(c))


def parse_keywords(spec: str | Sequence[str] | None) -> list[str]:
    """Comma list -> trimmed, lower-cased, non-empty keywords (plan-build time)."""
    if spec is None:
        return []
    items: Iterable[str] = spec.split(",") if isinstance(spec, str) else spec
    return [k.strip().lower() for k in items if k and k.strip()]


def parse_keywords_col(spec: ColumnOrName) -> Column:
    """Same as :func:`parse_keywords` when the list is itself a column."""
    return F.filter(F.transform(F.split(_c(spec), ","), lambda k: F.lower(F.trim(k))), lambda k: k != "")


_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")


def any_regex(text: ColumnOrName, keywords: Sequence[str]) -> Column:
    """Lower-cased text matches any keyword as a regular expression. Many keywords
    without a special character are matched together, as literals."""
    low = F.lower(_c(text))
    if not keywords:
        return F.lit(False)
    hit = None
    plain = [kw for kw in keywords if kw and not _SPECIAL.search(kw)]
    if len(plain) > FEW_KEYWORDS:
        hit = contains_any(low, plain)
        keywords = [kw for kw in keywords if not kw or _SPECIAL.search(kw)]
    for kw in keywords:
        term = low.rlike(kw)
        hit = term if hit is None else (hit | term)
    return F.coalesce(hit, F.lit(False))


def any_literal(texts: Sequence[ColumnOrName], keywords: Sequence[str]) -> Column:
    """Any keyword is a literal substring of any lower-cased text (null text -> "")."""
    if not keywords:
        return F.lit(False)
    lows = [F.lower(_blank(t)) for t in texts]
    hit = None
    if len(keywords) > FEW_KEYWORDS:
        for low in lows:
            term = contains_any(low, keywords)
            hit = term if hit is None else (hit | term)
        return hit
    for kw in keywords:
        for low in lows:
            term = F.instr(low, kw) > 0
            hit = term if hit is None else (hit | term)
    return hit


def slug(c: ColumnOrName, max_len: int | None = None, default: str = DEFAULT_SLUG) -> Column:
    """Keep letters, digits, '_' and '-'; cut to ``max_len``; empty -> default."""
    kept = F.regexp_replace(_blank(c), r"[^\p{L}\p{N}_-]", "")
    if max_len is not None:
        kept = F.substring(kept, 1, max_len)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def judge_slug(query: ColumnOrName) -> Column:
    """Judge file-name slug: a missing query gives ``no_query``; otherwise cut at 40."""
    q = _c(query)
    cut = F.substring(F.regexp_replace(q, r"[^\p{L}\p{N}_-]", ""), 1, JUDGE_SLUG_MAX)
    return F.when(q.isNull() | (q == ""), F.lit(DEFAULT_JUDGE_SLUG)).otherwise(cut)


def file_stem(path: ColumnOrName) -> Column:
    """Last path segment without its final extension."""
    last = F.regexp_extract(_c(path), r"([^/\\]*)$", 1)
    return F.when(last.rlike(r"^.+\.[^.]*$"), F.regexp_extract(last, r"^(.*)\.[^.]*$", 1)).otherwise(last)


def short_model_name(model: ColumnOrName, variant: str = "eval") -> Column:
    """Last path segment of a model id (``org/name`` -> ``name``).

    ``eval`` (experiment names): trailing slashes removed first.
    ``search`` (output folders): backslashes read as slashes, nothing removed,
    so a trailing slash gives "".
    """
    m = _c(model)
    if variant == "eval":
        return F.substring_index(F.regexp_replace(m, "/+$", ""), "/", -1)
    if variant == "search":
        return F.substring_index(F.regexp_replace(m, r"\\", "/"), "/", -1)
    raise ValueError("variant must be 'eval' or 'search'")


def strip_code_fences(raw: ColumnOrName) -> Column:
    """Strip a fenced block: only when the stripped text starts with three
    backticks; the capture runs greedily to the last fence; unchanged when no
    closing fence exists."""
    t = ustrip(raw)
    fenced = t.startswith(CODE_FENCE) & t.rlike(CODE_FENCE_PATTERN)
    return F.when(fenced, ustrip(F.regexp_extract(t, CODE_FENCE_PATTERN, 1))).otherwise(t)
