"""Unique products and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.text import product_text, unique_product_key
from shelfrank.schema import require_columns

CATALOG_SOURCE_COLUMNS = ("ProductName", "BrandName", "ProductType", "Level4_ProductGroup", "PageLanguage")


def unique_products(impressions: DataFrame, order_by: str = "product_id") -> DataFrame:
    """One row per ``name / brand / type`` key; the other columns come from
    the row with the smallest ``order_by`` (the stated stand-in for "first row
    in file order").

    ``min_by`` over a struct is a declarative aggregate with a partial phase,
    so a hot key is reduced map-side before the shuffle.
    """
    require_columns(impressions, [*CATALOG_SOURCE_COLUMNS, order_by])
    keyed = impressions.select(*CATALOG_SOURCE_COLUMNS, order_by).withColumn("unique_key", unique_product_key())
    payload = F.struct(*[F.col(c) for c in (*CATALOG_SOURCE_COLUMNS, order_by)])
    kept = keyed.groupBy("unique_key").agg(F.min_by(payload, F.col(order_by)).alias("_p"))
    out = kept.select(*[F.col(f"_p.{c}").alias(c) for c in CATALOG_SOURCE_COLUMNS], "unique_key", F.col(f"_p.{order_by}").alias(order_by))
    return out.select(
        *CATALOG_SOURCE_COLUMNS,
        "unique_key",
        product_text("catalog").alias("product_text"),
        order_by,
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.where(F.col(col).isNotNull()).select(col).distinct()
