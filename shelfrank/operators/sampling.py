"""Seeded order, exact global rank, exact-size samples and first-N groups.

:func:`global_rank` gives every row its exact 1-based position in the seeded
order without a single-partition window: rows are bucketed by the leading hex
digits of their md5 (uniform), ranked inside their bucket, and shifted by the
running count of the smaller buckets. The offsets table has at most
``16**hex_digits`` rows per partition value; no broadcast of it is forced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.keys import DEFAULT_SEED, hash_bucket, row_key
from shelfrank.functions.text import ColumnOrName, _c
from shelfrank.session import materialize


def global_rank(
    df: DataFrame,
    key: ColumnOrName,
    seed: int | str | Column = DEFAULT_SEED,
    out: str = "grank",
    partition_by: Sequence[str] = (),
    hex_digits: int = 4,
    with_total: bool = True,
) -> DataFrame:
    """Exact rank in ``md5(seed ':' key)`` order (ties by key), per ``partition_by``.

    Adds ``out`` (bigint) and, with ``with_total``, ``<out>_total`` — the number
    of rows of the partition value.
    """
    parts = list(partition_by)
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    d = df.withColumn("_k", _c(key).cast("string"))
    d = d.withColumn("_h", F.md5(F.concat(seed_col.cast("string"), F.lit(":"), F.col("_k"))))
    d = d.withColumn("_b", hash_bucket("_h", hex_digits))
    counts = d.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*parts).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(
        *parts,
        "_b",
        (F.sum("_n").over(running) - F.col("_n")).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*parts)).alias("_tot"),
    )
    w = Window.partitionBy(*parts, "_b").orderBy("_h", "_k")
    ranked = d.withColumn("_r", F.row_number().over(w)).join(offsets, [*parts, "_b"])
    ranked = ranked.withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint"))
    if with_total:
        ranked = ranked.withColumn(f"{out}_total", F.col("_tot").cast("bigint"))
    return ranked.drop("_k", "_h", "_b", "_r", "_off", "_tot")


def nth_keys(keys: DataFrame, ranks: Callable[[int], Sequence[int]], hex_digits: int = 4) -> list[tuple[Column, int, int] | None]:
    """Exact k-th smallest order keys (1-based): for each k of ``ranks(rows)`` the key as a
    literal, the rows below it and the rows equal to it; None where k < 1 or beyond the rows.

    ``keys`` is a written table with the struct ``_key`` (md5 hex ``h``, raw key ``q``).
    Rows are counted per md5-prefix bucket in one pass (at most ``16**hex_digits``
    counts come to the driver); a second pass over the few buckets that hold a wanted
    key orders these (uniform hashing keeps a bucket small) and returns one row for each.
    """
    b = keys.select("_key", hash_bucket(F.col("_key")["h"], hex_digits).alias("_b"))
    counts = sorted((r["_b"], r["n"]) for r in b.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    wanted = list(ranks(sum(n for _, n in counts)))
    places: dict[int, tuple[int, int]] = {}
    below = 0
    for bucket, n in counts:
        places |= {k: (bucket, below) for k in wanted if below < k <= below + n}
        below += n
    if not places:
        return [None] * len(wanted)
    inside = b.where(F.col("_b").isin(sorted({p for p, _ in places.values()}))).groupBy("_b", "_key").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.create_map(*[F.lit(x) for pair in {p: before for p, before in places.values()}.items() for x in pair])
    upto = inside.withColumn("_to", F.sum("_n").over(running) + offset[F.col("_b")])
    hit = F.lit(False)
    for k in places:
        hit = hit | ((F.col("_to") >= k) & (F.col("_to") - F.col("_n") < k))
    found = upto.where(hit).collect()  # one row a wanted rank
    out = []
    for k in wanted:
        r = next((r for r in found if r["_to"] - r["_n"] < k <= r["_to"]), None)
        out.append(r and (F.struct(F.lit(r["_key"]["h"]).alias("h"), F.lit(r["_key"]["q"]).alias("q")), r["_to"] - r["_n"], r["_n"]))
    return out


def order_key(key: Column, seed: int) -> Column:
    """Seeded order of a key as a comparable struct: md5 hex, then the key itself."""
    return F.struct(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))).alias("h"), key.cast("string").alias("q"))


def exact_sample(
    df: DataFrame,
    n: int,
    key_cols: Sequence[ColumnOrName],
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, chosen by the
    seeded order of ``key_cols`` (never ``DataFrame.sample``, whose size is
    inexact). Only the order keys are written and counted; rows are then kept in place by
    comparing their key with the n-th smallest. Of rows that share that key the
    remaining number is taken."""
    if n < 0:
        raise ValueError("n must be >= 0")
    key = order_key(row_key(key_cols), seed)
    [last] = nth_keys(materialize(df.select(key.alias("_key"))), lambda rows: [min(n, rows)])
    if last is None:
        return df.limit(0)
    threshold, below, equal = last
    if below + equal <= n:
        return df.where(key <= threshold)
    return df.where(key < threshold).unionByName(df.where(key == threshold).limit(n - below))


def seeded_first_groups(
    df: DataFrame, group: str, n: int | None, seed: int = DEFAULT_SEED, where: Column | None = None
) -> DataFrame:
    """Distinct group keys (optionally filtered), in seeded order; the
    first ``n`` (``None`` or ``n <= 0`` keeps all). One column."""
    g = df if where is None else df.where(where)
    keys = g.where(F.col(group).isNotNull()).select(group).distinct()
    if n is None or n <= 0:
        return keys
    return exact_sample(keys, n, [group], seed)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)
