"""Dataset profiling.

All counts are partial aggregations (map-side combine); histograms compute
their bounds in one small aggregate and bin every value against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.text import PASSAGE_PREFIX, QUERY_PREFIX, unique_product_key, with_prefix


def positives_per_query(judged: DataFrame, query: str = "OriginalQuery", rel: str = "relevant") -> DataFrame:
    """D4 + D6: products and positives per query."""
    return judged.groupBy(query).agg(
        F.count(F.lit(1)).alias("num_products"), F.sum(rel).cast("bigint").alias("num_positives")
    )


def dataset_summary(judged: DataFrame, query: str = "OriginalQuery", rel: str = "relevant") -> DataFrame:
    """C3 + D5 + D6 + D7: query counts and the three "products per query" figures.

    ``avg_products_per_query``  rows per query over all queries
    ``avg_products_all_rows``   all rows / max(queries with a positive, 1)
    ``avg_products_selected``   rows of queries with a positive / max(that count, 1)
    """
    pq = judged.where(F.col(query).isNotNull()).groupBy(query).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rel).alias("pos")
    )
    npos = F.count_if(F.col("pos") > 0)
    return pq.agg(
        F.count(F.lit(1)).alias("num_queries_total"),
        npos.alias("num_queries_with_positive"),
        F.sum("n").cast("bigint").alias("total_rows"),
        F.avg("n").alias("avg_products_per_query"),
        (F.sum("n").cast("double") / F.greatest(npos, F.lit(1))).alias("avg_products_all_rows"),
        (F.sum(F.when(F.col("pos") > 0, F.col("n"))).cast("double") / F.greatest(npos, F.lit(1))).alias(
            "avg_products_selected"
        ),
    )


def cleaning_counts(impressions: DataFrame) -> DataFrame:
    """Row counts of each cleaning step, in one pass."""
    return impressions.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("OriginalQuery").isNotNull()).alias("rows_with_query"),
        F.count_if(F.col("PageLanguage") == "de").alias("rows_de"),
        F.countDistinct("OriginalQuery").alias("unique_queries"),
        F.countDistinct(unique_product_key()).alias("unique_products"),
    )


def label_counts(df: DataFrame, rel: str = "relevant") -> DataFrame:
    """D2 + D3: rows per label value."""
    return df.groupBy(rel).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent non-null values (ties by value)."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
        .limit(n)
        .select(F.lit(col).alias("field"), F.col(col).alias("value"), "n")
    )


def class_histogram(
    df: DataFrame, value: str, cls: Column | None = None, bins: int = 50, require_classes: int | None = None
) -> DataFrame:
    """Equal-width histogram of ``value`` per class, each class on its
    own min–max range (widened by ±0.5 when min = max, so one bin — the middle
    one — holds everything). The maximum falls in the last bin.

    Without ``cls`` there is one class, ``all``, whose bounds are scalar
    subqueries; with classes, the per-class bounds (one row per class) are
    joined on the class. With ``require_classes``, rows are emitted only when
    that many classes exist.
    """

    def widen(mn: Column, mx: Column) -> tuple[Column, Column]:
        return F.when(mn == mx, mn - 0.5).otherwise(mn), F.when(mn == mx, mx + 0.5).otherwise(mx)

    if cls is None:
        v = df.select(F.lit("all").alias("cls"), F.col(value).cast("double").alias("v"))
        b = df.select(F.min(F.col(value).cast("double")).alias("mn"), F.max(F.col(value).cast("double")).alias("mx"))
        lo, hi = widen(b.select("mn").scalar(), b.select("mx").scalar())
        binned = v.withColumn("lo", lo).withColumn("hi", hi)
    else:
        v = df.select(cls.alias("cls"), F.col(value).cast("double").alias("v"))
        bounds = v.groupBy("cls").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
        lo, hi = widen(F.col("mn"), F.col("mx"))
        binned = v.join(bounds.select("cls", lo.alias("lo"), hi.alias("hi")), "cls")
    binned = binned.withColumn(
        "bin",
        F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins)), F.lit(bins - 1)).cast("int"),
    )
    if require_classes is not None:
        n_cls = v.select(F.countDistinct("cls").alias("c")).scalar()
        binned = binned.where(n_cls == require_classes)
    width = (F.min("hi") - F.min("lo")) / F.lit(bins)
    return binned.groupBy("cls", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.min("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
    ).withColumnRenamed("cls", "class")


def encoding_workload(judged: DataFrame, query: str = "OriginalQuery", text: str = "product_text", rel: str = "relevant") -> DataFrame:
    """Embedding work of a per-query evaluation (2 calls per query, 1 +
    products texts per query) next to the distinct texts we actually encode."""
    posq = judged.groupBy(query).agg(F.sum(rel).alias("_p")).where(F.col("_p") > 0).select(query)
    sel = judged.join(posq, query, "left_semi")
    nq = posq.select(F.count(F.lit(1))).scalar()
    return sel.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.countDistinct(with_prefix(QUERY_PREFIX, query)).alias("distinct_query_texts"),
        F.countDistinct(with_prefix(PASSAGE_PREFIX, text)).alias("distinct_passage_texts"),
    ).select(
        nq.cast("bigint").alias("num_queries"),
        (F.lit(2) * nq).cast("bigint").alias("total_api_calls"),
        (nq + F.col("_rows")).cast("bigint").alias("total_texts_embedded"),
        "distinct_query_texts",
        "distinct_passage_texts",
    )
