"""Declared schemas and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


IMPRESSIONS = _struct(
    ("OriginalQuery", S),
    ("PageLanguage", S),
    ("product_id", L),
    ("ProductName", S),
    ("BrandName", S),
    ("Level4_ProductGroup", S),
    ("ProductType", S),
    ("UniqueSelects", L),
)

JUDGED = _struct(
    ("OriginalQuery", S), ("PageLanguage", S), ("product_text", S), ("relevant", I), ("product_id", L)
)

CATALOG = _struct(
    ("ProductName", S),
    ("BrandName", S),
    ("ProductType", S),
    ("Level4_ProductGroup", S),
    ("PageLanguage", S),
    ("unique_key", S),
    ("product_text", S),
    ("product_id", L),
)

METRIC_NAMES = ("hit@1", "hit@5", "hit@10", "mrr@1", "mrr@5", "mrr@10", "ndcg@1", "ndcg@5", "ndcg@10")

# Union of the three metrics-document variants; every key nullable.
METRICS_DOC = T.StructType(
    _struct(
        ("model_name_or_path", S),
        ("model", S),
        ("exp_name", S),
        ("provider", S),
        ("test_file", S),
        ("timestamp", S),
        ("num_queries_total", L),
        ("num_queries_with_positive", L),
        ("avg_products_per_query", D),
        ("queries_evaluated", L),
        ("num_queries", L),
        *[(m, D) for m in METRIC_NAMES],
        ("total_time_sec", D),
        ("total_api_calls", L),
        ("total_texts_embedded", L),
    ).fields
    + [T.StructField("language_distribution", T.MapType(S, D), True)]
)

EXPERIMENTS = _struct(("exp_name", S), ("kind", S), ("model_id", S), ("provider", S), ("note", S))

MODEL_ATTRIBUTES = _struct(("model_id", S), ("params_millions", D), ("embedding_dim", I), ("num_layers", I))

LEADERBOARD_COLUMNS = (
    "exp_name", "kind", "provider", "model_id", "note",
    "hit@1", "hit@5", "hit@10", "mrr@10", "ndcg@10",
    "num_queries", "total_time_sec", "queries_per_sec", "queries_per_min",
    "total_texts_embedded", "texts_per_sec", "texts_per_min",
    "params_millions", "embedding_dim", "num_layers",
)

JUDGE_SCORES = _struct(("relevance", D), ("diversity", D), ("usefulness", D), ("safety", D))
VERDICT = T.StructType(
    [
        T.StructField("query", S, True),
        T.StructField("model_a_label", S, True),
        T.StructField("model_b_label", S, True),
        T.StructField(
            "scores",
            T.StructType([T.StructField("model_a", JUDGE_SCORES, True), T.StructField("model_b", JUDGE_SCORES, True)]),
            True,
        ),
        T.StructField("overall_better", S, True),
        T.StructField("explanation", S, True),
    ]
)


class MissingColumnsError(KeyError):
    pass


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Raise listing every missing column (checked at plan-build time, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing columns in source data: {missing}")
    return df
