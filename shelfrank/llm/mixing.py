"""Operator 10: mix sources to target weights with hash-threshold histograms.

Every row gets a hash; a source takes whole copies of itself plus the rows whose
hash lies below a threshold. The threshold comes from word sums per (source,
hash bucket): the bucket where the running sum passes the budget is split into
finer buckets, level after level, and only that bucket's rows are read again.
Nothing is sorted and only sums are shuffled. Two levels hash the id, two more
the row's content, so where rows lie never matters; equal rows, which no hash
parts, are counted. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.llm.common import WORD, uniform_bits, written

#: Bits per histogram level: at most 4,096 buckets a source. Two levels hash the
#: row's id, two more its id, source and content.
LEVEL_BITS = 12
LEVELS = 4
#: A source's rows are joined in this many parts, so no source lands in one task.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _content(columns: list[T.StructField], row: str | None = None) -> Column:
    """A 64-bit hash of a row's columns (maps and variants have no hash; they are left out)."""
    named = [F.col(f"{row}.`{f.name}`" if row else f"`{f.name}`") for f in columns if not re.search("map<|variant", f.dataType.simpleString())]
    return F.xxhash64(*named, *[c.isNull() for c in named])


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``m_b0``..``m_b3`` (bucket per level, from ``m_key`` and ``m_content``) and ``m_salt``."""
    both = 2 * LEVEL_BITS
    mask = (1 << LEVEL_BITS) - 1
    out = rows.withColumn("m_h", uniform_bits("m_key", bits=both, seed=seed))
    out = out.withColumn("m_r", uniform_bits("m_content", bits=both, seed=seed + 1))
    for i, c in enumerate(("m_h", "m_h", "m_r", "m_r")):
        part = F.shiftright(c, LEVEL_BITS) if i % 2 == 0 else F.col(c).bitwiseAND(mask)
        out = out.withColumn(f"m_b{i}", part.cast("int"))
    # the salt only deals rows to tasks, so equal rows may differ in it
    return out.withColumn("m_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).drop("m_h", "m_r")


def source_targets(sizes: DataFrame, budget_ratio: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """``(src, source_size)`` -> plus ``target``: the budget shared by weight, no
    source above ``cap`` times its size, the excess shared again by weight.

    With level L every source gets min(cap, L * weight); the sources in order of
    cap / weight give L from running sums. The windows hold one row a source.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_ratio = Window.orderBy("m_ratio", F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")
    )
    t = sizes.withColumn("m_w", weight).withColumn("m_cap", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("m_ratio", F.col("m_cap") / F.col("m_w"))
    t = t.withColumn("m_budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio)))
    left = F.col("m_budget") - F.coalesce(F.sum("m_cap").over(before), F.lit(0.0))
    open_weight = F.sum("m_w").over(everything) - F.coalesce(F.sum("m_w").over(before), F.lit(0.0))
    t = t.withColumn("m_level", left / open_weight)
    # the first source that its level does not fill; if all fill up, all stay at their caps
    level = F.max(F.when(F.col("m_level") <= F.col("m_ratio"), F.col("m_level"))).over(everything)
    target = F.least(F.col("m_cap"), F.coalesce(level * F.col("m_w"), F.col("m_cap")))
    return t.withColumn("target", target).select("src", "source_size", "target")


def _salted(thresholds: DataFrame) -> DataFrame:
    return thresholds.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("src", "t_src")


def _with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    t = _salted(thresholds)
    return rows.join(t, rows["m_src"].eqNullSafe(t["t_src"]) & (rows["m_salt"] == t["m_salt"]), "inner").drop(t["m_salt"])


def _next_level(rows: DataFrame, t: DataFrame, i: int) -> DataFrame:
    """Find, per source, the bucket of level ``i`` inside which the budget ends."""
    inside = _with_thresholds(rows, t.where("open"))
    for j in range(i):
        inside = inside.where(F.col(f"m_b{j}") == F.col(f"cut{j}"))
    hist = inside.groupBy("t_src", F.col(f"m_b{i}").alias(f"cut{i}")).agg(
        F.sum("m_size").alias("m_sum"), F.max("rest").alias("m_rest"), F.count(F.lit(1)).alias("m_rows"),
        (F.min("m_content") == F.max("m_content")).alias("m_equal"),
    )
    w = Window.partitionBy("t_src").orderBy(f"cut{i}")
    hist = hist.withColumn("m_cum", F.sum("m_sum").over(w))
    cut = (
        hist.where("m_cum > m_rest and m_cum - m_sum <= m_rest")
        .select(F.col("t_src").alias("c_src"), f"cut{i}", (F.col("m_rest") - (F.col("m_cum") - F.col("m_sum"))).alias("c_rest"), F.col("m_sum").alias("c_leaf"), F.col("m_rows").alias("c_rows"), F.col("m_equal").alias("c_equal"))
    )
    joined = t.join(cut, F.col("src").eqNullSafe(F.col("c_src")), "left")
    return joined.select(
        "src", "source_size", "target", "full", "open",
        F.coalesce("c_rest", "rest").alias("rest"), F.coalesce("c_leaf", "leaf").alias("leaf"),
        F.coalesce("c_rows", "leaf_rows").alias("leaf_rows"), F.coalesce("c_equal", "leaf_equal").alias("leaf_equal"),
        *[f"cut{j}" for j in range(i + 1)],
    )


def mix_thresholds(
    rows: DataFrame, budget_ratio: float, weights: tuple[int, ...], cap: float
) -> DataFrame:
    """Per source: whole copies ``full``, the nested cuts that end the rest, and
    ``leaf_take``: how many of the ``leaf_rows`` rows of the last bucket come too.

    The last bucket holds one row, or rows equal in every hashed column: as many
    of them as come nearest to the rest. Different rows that share all 48 bits
    come all or not at all.
    """
    sizes = rows.groupBy(F.col("m_src").alias("src")).agg(F.sum("m_size").alias("source_size"))
    t = source_targets(sizes, budget_ratio, weights, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int")
    t = t.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    t = t.withColumn("open", F.col("rest") > 0).withColumn("leaf", F.lit(0).cast("long"))
    t = t.withColumn("leaf_rows", F.lit(0).cast("long")).withColumn("leaf_equal", F.lit(True))
    t = written(t, "mix-sources")
    for i in range(LEVELS):
        t = written(_next_level(rows, t, i), "mix-cuts")  # one row a source
    share = F.col("rest") / F.nullif(F.col("leaf"), F.lit(0))
    some = F.least(F.floor(share * F.col("leaf_rows") + 0.5).cast("long"), F.col("leaf_rows"))
    take = F.when(F.col("leaf_equal"), some).otherwise(F.when(share >= 0.5, F.col("leaf_rows")).otherwise(0))
    return t.withColumn("leaf_take", F.coalesce(take, F.lit(0)).cast("long"))


def _below() -> tuple[Column, Column]:
    """Whether a row lies below its source's nested cuts, and whether it lies in the last bucket."""
    below = F.lit(False)
    same = F.col("open")
    for i in range(LEVELS):
        below = below | (same & (F.col(f"m_b{i}") < F.col(f"cut{i}")))
        same = same & (F.col(f"m_b{i}") == F.col(f"cut{i}"))
    return F.coalesce(below, F.lit(False)), F.coalesce(same, F.lit(False))


def _with_copies(rows: DataFrame, t: DataFrame) -> DataFrame:
    """Adds ``copies``: whole copies, plus one for the rows that the cuts take.

    Only where some, not all, of the equal rows in a last bucket come are those
    rows written and numbered: by the part they were written in, with the parts'
    counts summed, so that no task holds them all.
    """
    below, last = _below()
    full = F.col("full")
    partial = (F.col("leaf_take") > 0) & (F.col("leaf_take") < F.col("leaf_rows"))
    joined = _with_thresholds(rows, t)
    whole = full + F.when(below | (last & (F.col("leaf_take") > 0)), 1).otherwise(0)
    if t.where(partial).isEmpty():
        return joined.withColumn("copies", whole)
    names = [*rows.columns, "full", "leaf_take", "source_size", "target"]
    leaf = joined.where(last & partial).select(*names, F.spark_partition_id().alias("m_part"), F.monotonically_increasing_id().alias("m_at"))
    leaf = written(leaf, "mix-leaf")
    counts = leaf.groupBy("m_src", "m_part").agg(F.count(F.lit(1)).alias("m_n"))
    earlier = Window.partitionBy("m_src").orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("m_src").alias("p_src"), F.col("m_part").alias("p_part"), F.coalesce(F.sum("m_n").over(earlier), F.lit(0)).alias("m_before"))
    numbered = leaf.withColumn("m_no", F.row_number().over(Window.partitionBy("m_src", "m_part").orderBy("m_at")))
    numbered = numbered.join(counts, F.col("m_src").eqNullSafe(F.col("p_src")) & (F.col("m_part") == F.col("p_part")))
    extra = F.when(F.col("m_before") + F.col("m_no") <= F.col("leaf_take"), 1).otherwise(0)
    rest = joined.where(~(last & partial)).select(*names, whole.alias("copies"))
    return rest.unionByName(numbered.select(*names, (full + extra).alias("copies")))


def mix_copies(
    docs: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    budget_ratio: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    cap: float = 2.0,
    seed: int = 20,
    keep_columns: bool = False,
    copies: str = "copies",
) -> DataFrame:
    """How often the mix takes each row.

    Returns ``key, source, size, source_size, target, copies, taken``, or with
    ``keep_columns`` the columns of ``docs`` plus one named ``copies``.

    Null and empty texts have size 0; a null source is a source of its own, last
    in order. Rows that repeat an id are told apart by source and text, with
    ``keep_columns`` by all their columns; rows equal in these are counted, so
    reruns agree on any partitioning. A source without words has target 0 and its
    rows stay once. An empty table gives an empty result. Extra columns may have
    any name; without ``keep_columns`` they are not read.
    """
    names = [F.col(key).alias("m_key"), F.col(source).alias("m_src")]
    fields = [docs.schema[c] for c in dict.fromkeys((key, source, text))]
    if keep_columns:
        rows = docs.select(*names, _content(docs.schema.fields).alias("m_content"), F.struct("*").alias("m_row"))
        sized = rows.withColumn("m_size", word_count(F.col(f"m_row.`{text}`"))).drop("m_row")
    else:
        sized = docs.select(*names, _content(fields).alias("m_content"), word_count(F.col(text)).alias("m_size"))
    slim = written(_hashed(sized, seed), "mix-rows")
    t = written(mix_thresholds(slim, budget_ratio, weights, cap), "mix-thresholds")
    if keep_columns:
        return _with_copies(_hashed(rows, seed), t).select("m_row.*", F.col("copies").alias(copies))
    out = _with_copies(slim, t)
    return out.select(
        F.col("m_key").alias(key), F.col("m_src").alias(source), F.col("m_size").alias("size"), "source_size", "target", "copies",
        (F.col("m_size") * F.col("copies")).alias("taken"),
    )


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed table itself: each row as often as the mix takes it."""
    free = max(docs.columns, key=len) + "_"  # names that no column has
    chosen = mix_copies(docs, keep_columns=True, copies=f"{free}n", **params)
    times = F.array_repeat(F.lit(1), F.col(f"`{free}n`").cast("int"))
    return chosen.select("*", F.explode(times).alias(f"{free}i")).select(*[f"`{c}`" for c in docs.columns])
