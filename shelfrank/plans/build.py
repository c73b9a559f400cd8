"""Reusable plan fragments: base inputs and the text-encoding chain.

These compose operators into the inputs most queries share; they return lazy
DataFrames and run nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.text import PASSAGE_PREFIX, QUERY_PREFIX, with_prefix
from shelfrank.functions.vectors import squared_norm
from shelfrank.operators.dedup import unique_products
from shelfrank.operators.encode import HashingEncoder, cached_encode, distinct_texts, encode_distinct
from shelfrank.operators.labels import judged_table
from shelfrank.operators.ranking import attach_vectors, score_pairs
from shelfrank.operators.search import catalog_topk
from shelfrank.operators.splits import assign_splits
from shelfrank.session import materialize
from shelfrank.sources.adapters import impressions


def impressions_df(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    """The impressions adapter; ``materialized`` checkpoints it once so that
    every branch of a multi-branch plan reads the written copy."""
    df = impressions(spark, sf_dir)
    return materialize(df) if materialized else df


def judged_df(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    return judged_table(impressions_df(spark, sf_dir, materialized))


def catalog_df(spark: SparkSession, sf_dir: str, materialized: bool = False) -> DataFrame:
    return unique_products(impressions_df(spark, sf_dir, materialized))


def judged_and_catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both inputs of a search from **one** materialized impressions table."""
    imp = impressions_df(spark, sf_dir, materialized=True)
    return judged_table(imp), unique_products(imp)


def split_df(spark: SparkSession, sf_dir: str, materialized: bool = True) -> DataFrame:
    """Judged rows with their split. The judged rows feed both the per-query
    split table and the join back, so they are materialized by default."""
    return assign_splits(judged_df(spark, sf_dir, materialized))


def scored_text_candidates(judged: DataFrame, encoder) -> DataFrame:
    """E3 + F1 + F3: each (query, product text) row scored with ``encoder``.

    Model encoders (``per_row`` False) see each distinct query text and each
    distinct product text once; the vectors are joined back on the text. A
    cheap expression encoder is evaluated in place, which saves two shuffles
    and two joins.
    """
    q_text = with_prefix(QUERY_PREFIX, "OriginalQuery")
    p_text = with_prefix(PASSAGE_PREFIX, "product_text")
    if getattr(encoder, "per_row", False):
        c = judged.withColumn("q_emb", encoder.column(q_text)).withColumn("p_emb", encoder.column(p_text))
        c = c.withColumn("q_sq", squared_norm("q_emb")).withColumn("p_sq", squared_norm("p_emb"))
    else:
        qv = encode_distinct(judged, "OriginalQuery", encoder, prefix=QUERY_PREFIX)
        pv = encode_distinct(judged, "product_text", encoder, prefix=PASSAGE_PREFIX)
        c = attach_vectors(judged, qv, pv, q_text, p_text)
    scored = score_pairs(c, "q_emb", "p_emb", normalized=encoder.normalized, q_sq="q_sq", p_sq="p_sq")
    return scored.drop("q_emb", "p_emb", "q_sq", "p_sq")


def query_vectors(judged: DataFrame, encoder) -> DataFrame:
    """One row per distinct query: ``query, q_emb, q_sq``."""
    qs = judged.where(F.col("OriginalQuery").isNotNull()).select(F.col("OriginalQuery").alias("query")).distinct()
    enc = encoder.encode(qs.withColumn("_t", with_prefix(QUERY_PREFIX, "query")), "_t", "q_emb")
    return enc.select("query", "q_emb", squared_norm("q_emb").alias("q_sq"))


def catalog_vectors(catalog: DataFrame, encoder, cache_path: str | None = None) -> DataFrame:
    """Catalog rows with ``p_emb, p_sq`` (distinct texts encoded once for model
    encoders; in place for a cheap expression encoder). With ``cache_path`` vectors
    come from the model's cache there, and missing ones are added to it."""
    p_text = with_prefix(PASSAGE_PREFIX, "product_text")
    if cache_path is None and getattr(encoder, "per_row", False):
        c = catalog.withColumn("p_emb", encoder.column(p_text))
        return c.withColumn("p_sq", squared_norm("p_emb"))
    if cache_path is None:
        pv = encode_distinct(catalog, "product_text", encoder, prefix=PASSAGE_PREFIX)
    else:
        wanted = distinct_texts(catalog, "product_text", prefix=PASSAGE_PREFIX)
        pv = cached_encode(catalog.sparkSession, wanted, encoder, cache_path).withColumn("sq_norm", squared_norm("embedding"))
    c = catalog.withColumn("_pt", p_text)
    return c.join(
        pv.select(F.col("text").alias("_pt"), F.col("embedding").alias("p_emb"), F.col("sq_norm").alias("p_sq")), "_pt"
    ).drop("_pt")


def search_catalog(judged: DataFrame, catalog: DataFrame, encoder, k: int) -> DataFrame:
    """All distinct queries against the whole catalog: ``query, product_id, score, rank``."""
    return catalog_topk(
        query_vectors(judged, encoder),
        catalog_vectors(catalog, encoder),
        k,
        query_key="query",
        product_key="product_id",
        normalized=encoder.normalized,
    )


def default_encoder(dim: int = 64) -> HashingEncoder:
    return HashingEncoder(dim)
