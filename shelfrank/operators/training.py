"""Training-set preparation (I1–I3): pairs, shuffled batches, run plan.

Batches are computed, not streamed: every (epoch, row) gets an exact position
in a seeded order (:func:`global_rank`, no single-partition window) and
``batch_id = (position - 1) div batch_size``; the last batch of an epoch is
short. Writing the result partitioned or sorted by (epoch, batch_id) gives a
trainer its in-batch-negative batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.keys import DEFAULT_SEED, row_key
from shelfrank.functions.text import PASSAGE_PREFIX, QUERY_PREFIX, with_prefix
from shelfrank.operators.labels import positives
from shelfrank.operators.ranking import rank_candidates_sorted
from shelfrank.operators.sampling import exact_sample, global_rank
from shelfrank.session import materialize

WARMUP_FRACTION = 0.1


def training_pairs(
    split_rows: DataFrame,
    split: str | None = "train",
    max_rows: int | None = None,
    seed: int = DEFAULT_SEED,
    query: str = "OriginalQuery",
    key: str = "product_id",
    keep_key: bool = False,
) -> DataFrame:
    """(query text, positive passage) pairs of one split, optionally an
    exact-size seeded sample of them."""
    df = split_rows if split is None else split_rows.where(F.col("split") == split)
    df = positives(df)
    if max_rows is not None:
        df = exact_sample(df, max_rows, [query, key], seed)
    out = df.select(
        row_key([query, key]).alias("pair_key"),
        with_prefix(QUERY_PREFIX, query).alias("query_text"),
        with_prefix(PASSAGE_PREFIX, "product_text").alias("product_text"),
    )
    return out if keep_key else out.drop("pair_key")


def training_batches(pairs: DataFrame, batch_size: int = 256, epochs: int = 1, seed: int = DEFAULT_SEED) -> DataFrame:
    """Each pair once per epoch with ``epoch, position, batch_id``.

    The order of epoch ``e`` is md5(``seed:e:pair_key``) — a different shuffle
    per epoch, reproducible in any engine.
    """
    if batch_size < 1 or epochs < 1:
        raise ValueError("batch_size and epochs must be >= 1")
    ep = pairs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    seed_col = F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"))
    r = global_rank(ep, "pair_key", seed_col, "position", partition_by=["epoch"], with_total=False)
    return r.withColumn("batch_id", F.floor((F.col("position") - 1) / F.lit(batch_size)).cast("bigint"))


def spread_batches(
    pairs: DataFrame, batch_size: int = 256, epochs: int = 1, seed: int = DEFAULT_SEED, query: str = "query_text", key: str = "pair_key"
) -> DataFrame:
    """I2 for in-batch negatives: ``epoch, batch_id, slot, key, query``, where a
    batch holds no query twice unless the query has more pairs than there are batches.

    In an epoch the queries come in a seeded order and each query's pairs one
    after the other; the pair at position p of B batches goes to batch p mod B
    and slot p div B. A query's pairs are neighbours, so c of them meet in a
    batch at most ceil(c / B) times, which no assignment can undercut, and batch
    sizes differ by one at most. Only hashes and keys are shuffled: positions
    come from the segmented scan, so a query with a third of all pairs is spread
    over many tasks. Null queries count as one query. An empty table gives no rows.
    """
    if batch_size < 1 or epochs < 1:
        raise ValueError("batch_size and epochs must be >= 1")
    q, k = F.col(query).cast("string"), F.col(key).cast("string")
    seeded = F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"))
    order = F.struct(
        F.md5(F.concat(seeded, F.coalesce(q, F.lit("")))).alias("qh"), q.alias("q"), F.md5(F.concat(seeded, k)).alias("kh"), k.alias("k")
    )
    keys = pairs.select(F.col(key), F.col(query)).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    keys = keys.select("epoch", order.alias("_order"), F.lit(0.0).alias("_even"))
    placed = materialize(rank_candidates_sorted(keys, "epoch", "_even", "_order", "position", "bigint"))
    batches = placed.agg(F.ceil(F.max("position") / F.lit(batch_size)).cast("bigint").alias("n")).scalar()
    at = F.col("position") - 1
    return placed.select(
        "epoch",
        F.pmod(at, batches).alias("batch_id"),
        F.floor(at / batches).cast("bigint").alias("slot"),
        F.col("_order.k").alias(key),
        F.col("_order.q").alias(query),
    )


def batch_conflicts(batches: DataFrame, query: str = "query_text") -> DataFrame:
    """Per epoch: its batches and rows, the rows of one query that meet in a batch at
    most, the number that counts alone force, and the (batch, query) pairs above it."""
    meets = batches.groupBy("epoch", "batch_id", query).agg(F.count(F.lit(1)).alias("n"))
    sizes = meets.groupBy("epoch", "batch_id").agg(F.sum("n").alias("n"))
    per_epoch = sizes.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").cast("bigint").alias("n_rows"), F.max("n").alias("largest_batch"))
    # a query's least possible meeting: its rows over all batches, rounded up
    per_query = meets.groupBy("epoch", query).agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    counted = per_query.join(per_epoch, "epoch").withColumn("forced", F.ceil(F.col("rows") / F.col("n_batches")).cast("bigint"))
    return counted.groupBy("epoch").agg(
        F.max("n_batches").alias("n_batches"),
        F.max("n_rows").alias("n_rows"),
        F.max("largest_batch").alias("largest_batch"),
        F.max("most").alias("most_in_a_batch"),
        F.max("forced").alias("forced_in_a_batch"),
        F.count_if(F.col("most") > F.col("forced")).alias("unforced_queries"),
    )


def training_plan(pairs: DataFrame, batch_size: int = 256, epochs: int = 1) -> DataFrame:
    """steps = ceil(n / batch) × epochs, warm-up = ceil(0.1 × steps), one row."""
    n = F.count(F.lit(1))
    spe = F.ceil(n.cast("double") / F.lit(float(batch_size))).cast("bigint")
    return pairs.agg(n.alias("num_examples"), spe.alias("steps_per_epoch")).select(
        "num_examples",
        F.lit(batch_size).cast("int").alias("batch_size"),
        F.lit(epochs).cast("int").alias("epochs"),
        "steps_per_epoch",
        (F.col("steps_per_epoch") * epochs).cast("bigint").alias("num_training_steps"),
        F.ceil((F.col("steps_per_epoch") * epochs).cast("double") * F.lit(WARMUP_FRACTION)).cast("bigint").alias("warmup_steps"),
    )
