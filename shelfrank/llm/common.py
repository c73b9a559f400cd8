"""Helpers shared by the operators: scratch tables, word rules, 64-bit mixing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.session import scratch_path, ship_package

#: A word: a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's switch to remove a plan's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing)
    and keeps columns prunable for the branches that follow. What the write
    shuffled is not read again, so Spark removes it when the write has ended;
    otherwise a chain of writes holds all its shuffles until the driver collects garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(df: DataFrame) -> DataFrame:
    """Make this package's functions usable in the Python workers of ``df``."""
    ship_package(df.sparkSession)
    return df


def mix64(h: np.ndarray) -> np.ndarray:
    """Scramble uint64 values so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform_bits(*cols, bits: int, seed: int = 0):
    """The top ``bits`` of a 64-bit hash of ``cols``, as a long column."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 64 - bits)


#: Bits that stand for one id, and the most longs that hold such bits (2 MB).
ID_BITS, MOST_LONGS = 16, 1 << 18


def maybe_among(key: Column, ids: DataFrame, name: str = "k") -> Column:
    """True for every ``key`` (long) that ``ids`` holds, and for few others: a look-up in
    hashed bits. Their number follows the ids up to a bound, beyond which more
    others pass. It spares a join's shuffle, but a join must still decide."""
    longs = min(MOST_LONGS, 1 << max(0, ids.count() * ID_BITS // 64).bit_length())

    def at(c):
        h = F.pmod(F.xxhash64(c), F.lit(64 * longs))
        return F.shiftright(h, 6).cast("int"), h.bitwiseAND(63).cast("int")

    place, bit = at(F.col(name).cast("long"))
    there = ids.select(place.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
    none = ids.sparkSession.range(longs).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    words = there.unionAll(none).groupBy("w").agg(F.bit_or("b").alias("b"))
    row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("t"))  # at most MOST_LONGS
    place, bit = at(key)
    return F.bit_get(F.get(row.scalar(), place), bit) == 1
