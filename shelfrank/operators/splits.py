"""Query-level train/val/test split."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.keys import DEFAULT_SEED
from shelfrank.operators.sampling import global_rank, nth_keys, order_key
from shelfrank.session import materialize


def query_splits(
    df: DataFrame,
    query: str = "OriginalQuery",
    seed: int = DEFAULT_SEED,
    train: float = 0.8,
    val: float = 0.1,
) -> DataFrame:
    """C4: one row per distinct query with its split.

    Queries are put in seeded order; the first ``floor(train·n)`` go to train,
    the next ``floor(val·n)`` to val, the rest to test (fractions as doubles).
    """
    qs = df.where(F.col(query).isNotNull()).select(query).distinct()
    r = global_rank(qs, query, seed, "_qr")
    n = F.col("_qr_total").cast("double")
    n_train = F.floor(n * F.lit(float(train)))
    n_val = F.floor(n * F.lit(float(val)))
    split = (
        F.when(F.col("_qr") <= n_train, "train")
        .when(F.col("_qr") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return r.select(query, split.alias("split"))


def assign_splits(
    df: DataFrame,
    query: str = "OriginalQuery",
    seed: int = DEFAULT_SEED,
    train: float = 0.8,
    val: float = 0.1,
) -> DataFrame:
    """C4 + E1: every row gets the split of its query (all rows of a query share it).

    The order keys of the distinct queries are written once (one small row per query). A query's
    split is decided row by row from two threshold keys, at every size: train
    when its seeded key is at most the
    ``floor(train·n)``-th smallest, val up to the ``floor(train·n) +
    floor(val·n)``-th, test after. Both thresholds are found exactly in one pass over the written keys
    (:func:`nth_keys`) and enter the plan as literals, so no per-query table is
    broadcast or joined and the rows are never shuffled. Rows with a null query are
    dropped (they have no split).
    """
    key = order_key(F.col(query), seed)
    rows = df.where(F.col(query).isNotNull())
    keys = materialize(rows.select(key.alias("_key")).distinct())

    def ends(n: int) -> list[int]:
        first = math.floor(float(n) * train)
        return [first, first + math.floor(float(n) * val)]

    t_train, t_val = nth_keys(keys, ends)
    split = F.lit("test")
    if t_val:
        split = F.when(key <= t_val[0], "val").otherwise(split)
    if t_train:
        split = F.when(key <= t_train[0], "train").otherwise(split)
    return rows.withColumn("split", split)


def assign_splits_by_join(
    df: DataFrame, query: str = "OriginalQuery", seed: int = DEFAULT_SEED, train: float = 0.8, val: float = 0.1
) -> DataFrame:
    """The same result through the per-query table of :func:`query_splits`,
    joined back on the query (kept for comparison and for callers that need
    the table itself)."""
    return df.join(query_splits(df, query, seed, train, val), query)


def restrict_to(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Keep rows whose key is in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")
