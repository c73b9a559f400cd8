"""Operator 9: reproducible shuffle into shards by a Feistel permutation.

Rows get a global number in id order; a keyed Feistel network on the smallest
even-width bit domain that holds all numbers, walked until it lands inside
[0, n), permutes them. Shard and slot follow by division, so both can be
computed for any row number, and the row number for any shard and slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import mix64, python_ready, written

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round_keys(seed: int) -> list[np.uint64]:
    return list(mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)))


def _network(x: np.ndarray, half: int, keys) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys:
        left, right = right, left ^ (mix64(right + k) & mask)
    return (left << np.uint64(half)) | right


def _walk(i: np.ndarray, n: int, step) -> np.ndarray:
    x = step(i.astype(np.uint64))
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = step(x[out])
    return x.astype(np.int64)


def permute(i: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Place of row number ``i`` in the shuffle of ``n`` rows."""
    half, keys = _half_bits(n), _round_keys(seed)
    return _walk(i, n, lambda x: _network(x, half, keys))


def unpermute(place: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Row number at a place of the shuffle (the inverse of :func:`permute`)."""
    half, keys = _half_bits(n), _round_keys(seed)
    mask = np.uint64((1 << half) - 1)

    def back(x):
        left, right = x >> np.uint64(half), x & mask
        for k in reversed(keys):
            left, right = right ^ (mix64(left + k) & mask), left
        return (left << np.uint64(half)) | right

    return _walk(place, n, back)


def locate(i: np.ndarray, n: int, shards: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row number ``i``."""
    p = permute(np.asarray(i), n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 7) -> np.ndarray:
    """Row number in a shard's slot."""
    return unpermute(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``row_no``: 0, 1, ... over the whole table in ``order``.

    A range shuffle sorts the rows; numbers inside a partition are shifted by the
    counts of the partitions before it (a table of one row a partition). Rows
    equal in ``order`` may be dealt to several partitions: they are spread by
    their position, and any numbering of equal rows is the same result.
    """
    spread = rows.withColumn("s_spread", F.monotonically_increasing_id())
    cols = [*order, "s_spread"]
    ranged = spread.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("s_id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("s_part", F.shiftright("s_id", 33)).withColumn("s_local", F.col("s_id").bitwiseAND((1 << 33) - 1))
    kept = written(ranged.drop("s_spread", "s_id"), "numbered")
    counts = kept.groupBy("s_part").agg(F.count("*").alias("s_n"))
    w = Window.orderBy("s_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s_part", F.coalesce(F.sum("s_n").over(w), F.lit(0)).alias("s_start"))
    # one row a partition, so the broadcast is bounded by the partition count
    return kept.join(F.broadcast(starts), "s_part").withColumn("row_no", F.col("s_start") + F.col("s_local")).drop("s_part", "s_local", "s_start")


def shard_rows(docs: DataFrame, *, shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """``key, size, text_crc32, row_no, shard, slot`` for every row.

    Shard sizes in rows differ by one at most and slots have no gaps. Null texts
    count as empty; null ids come first; equal rows get neighbouring numbers in
    any order, which gives the same table; an empty table gives an empty result.
    Only ``key`` and ``text`` are read.
    """
    slim = docs.select(
        F.col(key).alias("s_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered = python_ready(number_rows(slim, ["s_key", "text_crc32", "size"]))
    n = numbered.count()

    @F.pandas_udf("long")
    def place(i: pd.Series) -> pd.Series:
        return pd.Series(permute(i.to_numpy(), n, seed))

    out = numbered.withColumn("s_place", place("row_no"))
    return out.select(
        F.col("s_key").alias(key), "size", "text_crc32", "row_no",
        F.pmod("s_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("s_place") / F.lit(shards)).cast("long").alias("slot"),
    )
