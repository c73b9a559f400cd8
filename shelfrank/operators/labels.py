"""Labelling, product texts, cleaning filters and keyword flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.keywords import contained
from shelfrank.functions.text import (
    PASSAGE_PREFIX,
    QUERY_PREFIX,
    any_literal,
    any_regex,
    product_text,
    relevance_label,
    with_prefix,
)
from shelfrank.schema import require_columns

PRODUCT_PARTS = ("ProductName", "BrandName", "Level4_ProductGroup", "ProductType")


def with_label(df: DataFrame, selects: str = "UniqueSelects", out: str = "relevant") -> DataFrame:
    """B1: relevance label from the selection count."""
    return df.withColumn(out, relevance_label(selects))


def with_product_text(df: DataFrame, variant: str, out: str = "product_text") -> DataFrame:
    """B2: one of the five product-text variants; absent part columns count as null."""
    parts = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in PRODUCT_PARTS]
    return df.withColumn(out, product_text(variant, name=parts[0], brand=parts[1], group=parts[2], ptype=parts[3]))


def judged_table(impressions: DataFrame, keep: Sequence[str] = ("product_id",)) -> DataFrame:
    """B1 + B2 (judged variant) + B3 + B4: rows with a query, their text and label.

    Text is never null after B2, so only null queries are dropped; empty texts stay.
    """
    require_columns(impressions, ["OriginalQuery", "PageLanguage", "UniqueSelects", *PRODUCT_PARTS])
    df = with_product_text(with_label(impressions), "judged")
    cols = ["OriginalQuery", "PageLanguage", "product_text", "relevant", *[c for c in keep if c in df.columns]]
    return df.select(*cols).na.drop(subset=["OriginalQuery", "product_text"])


def positives(df: DataFrame, rel: str = "relevant") -> DataFrame:
    """B5."""
    return df.where(F.col(rel) == 1)


def language_rows(df: DataFrame, lang: str = "de", col: str = "PageLanguage") -> DataFrame:
    """B6 (pushed down to the parquet scan when the column comes from one)."""
    return df.where(F.col(col) == lang)


def encoder_texts(df: DataFrame, query: str = "OriginalQuery", text: str = "product_text") -> DataFrame:
    """E5-style prefixed texts."""
    return df.withColumn("query_text", with_prefix(QUERY_PREFIX, query)).withColumn(
        "passage_text", with_prefix(PASSAGE_PREFIX, text)
    )


def keyword_hits(df: DataFrame, keywords: Sequence[str], text: str = "product_text") -> DataFrame:
    """Rows whose lower-cased text matches any keyword taken as a regex."""
    return df.where(any_regex(text, keywords))


def keyword_matches(df: DataFrame, keywords: Sequence[str], text: str = "product_text", out: str = "keywords") -> DataFrame:
    """B8 with the reason: the literal keywords found in the lower-cased text, sorted (none: empty)."""
    return df.withColumn(out, contained(F.lower(F.col(text)), keywords))


def with_block_flags(
    df: DataFrame,
    text_keywords: Sequence[str],
    type_keywords: Sequence[str],
    text: str = "product_text",
    out: str = "blocked",
) -> DataFrame:
    """B9 + B10: blocked if a text keyword is a literal substring of the
    lower-cased text, or a type keyword one of type or group (null or absent -> "")."""
    type_cols = [F.col(c) if c in df.columns else F.lit("") for c in ("ProductType", "Level4_ProductGroup")]
    return df.withColumn(out, any_literal([F.col(text)], text_keywords) | any_literal(type_cols, type_keywords))
