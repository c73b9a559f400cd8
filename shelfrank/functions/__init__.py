"""Column-level functions (pure Spark expressions)."""

from shelfrank.functions.keys import hash_bucket, row_key, seeded_hash
from shelfrank.functions.text import (
    any_literal,
    any_regex,
    judge_slug,
    parse_keywords,
    product_text,
    relevance_label,
    slug,
    strip_code_fences,
    unique_product_key,
    ustrip,
    with_prefix,
)
from shelfrank.functions.vectors import cosine_from_dot, dot, hashing_counts, l2_normalize, tokens

__all__ = [
    "any_literal",
    "any_regex",
    "cosine_from_dot",
    "dot",
    "hash_bucket",
    "hashing_counts",
    "judge_slug",
    "l2_normalize",
    "parse_keywords",
    "product_text",
    "relevance_label",
    "row_key",
    "seeded_hash",
    "slug",
    "strip_code_fences",
    "tokens",
    "unique_product_key",
    "ustrip",
    "with_prefix",
]
