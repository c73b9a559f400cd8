"""Scoring and ranking within each query.

Ranking order everywhere: NaN/null scores last, score descending, then the
candidate key ascending — a total order, so every rank is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.vectors import cosine_from_dot, dot


def _flag(score: str) -> Column:
    return F.col(score).isNull() | F.isnan(F.col(score))


def order_columns(score: str, key: str) -> list[Column]:
    """Window/sort order: NaN and null last, score desc, key asc."""
    return [_flag(score).asc(), F.col(score).desc_nulls_last(), F.col(key).asc()]


def order_struct(score: str, key: str) -> Column:
    """The same order as one comparable value (smaller ranks higher)."""
    flag = _flag(score)
    neg = F.when(flag, F.lit(0.0)).otherwise(-F.col(score).cast("double"))
    return F.struct(flag.alias("f"), neg.alias("s"), F.col(key).alias("k"))


def _ascending(score: str) -> Column:
    """The score as a double in rank order: negated, and NaN (which sorts last) for NaN or null."""
    return F.when(_flag(score), F.lit(float("nan"))).otherwise(-F.col(score).cast("double"))


def score_pairs(
    pairs: DataFrame,
    q_vec: str,
    p_vec: str,
    normalized: bool = True,
    q_sq: str | None = None,
    p_sq: str | None = None,
    out: str = "score",
) -> DataFrame:
    """dot product of two vector columns (normalized encoders), or the
    cosine computed from raw vectors and their squared norms."""
    d = dot(p_vec, q_vec)
    if normalized:
        return pairs.withColumn(out, d)
    return pairs.withColumn(out, cosine_from_dot(d, q_sq, p_sq))


def attach_vectors(
    candidates: DataFrame,
    query_vectors: DataFrame,
    product_vectors: DataFrame,
    query_text: Column,
    product_text: Column,
) -> DataFrame:
    """Join each candidate row to its query vector and product vector by text.

    Vector tables hold one row per distinct text; Spark broadcasts them when
    AQE measures them under the threshold, otherwise it shuffles both sides.
    """
    qv = query_vectors.select(
        F.col("text").alias("_qt"), F.col("embedding").alias("q_emb"), F.col("sq_norm").alias("q_sq")
    )
    pv = product_vectors.select(
        F.col("text").alias("_pt"), F.col("embedding").alias("p_emb"), F.col("sq_norm").alias("p_sq")
    )
    c = candidates.withColumn("_qt", query_text).withColumn("_pt", product_text)
    return c.join(qv, "_qt").join(pv, "_pt").drop("_qt", "_pt")


def rank_candidates(df: DataFrame, group: str, score: str, key: str, out: str = "rank") -> DataFrame:
    """G1: 1-based rank of every candidate within its group (window form:
    one task sorts each whole group; see :func:`rank_candidates_sorted` for
    groups that may hold a large share of all rows)."""
    w = Window.partitionBy(group).orderBy(*order_columns(score, key))
    return df.withColumn(out, F.row_number().over(w))


def rank_candidates_sorted(
    df: DataFrame, group: str, score: str, key: str, out: str = "rank", out_type: str = "int", keep: Sequence[str] | None = None
) -> DataFrame:
    """G1, skew-proof: exact rank by a segmented scan, without sorting any group in one task.

    1. A global sort on (group, order) is range-partitioned from a sample of
       the full sort key, so a hot group is spread over many partitions.
    2. Every task numbers its sorted rows, starting anew at each group, and the rows are
       written once with these numbers (shared folder).
    3. Only a partition's first group may have begun before it. One row a partition says
       which groups it begins and ends with and how many rows of the last one it holds; a
       running sum over these rows is the carry that is added to the first group's numbers.
       The carries are joined on the partition number (a broadcast bounded by the
       partition count); nothing is joined on the group.
    """
    from shelfrank.session import materialize, ship_package

    ship_package(df.sparkSession)
    s = df.withColumn("_o", _ascending(score))
    keys = [group, "_o", key]
    if keep is not None:
        s = s.select(*dict.fromkeys([*keep, *keys]))
    srt = s.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*(df.columns if keep is None else keep))
    schema = T.StructType([*srt.schema.fields, T.StructField("_pid", T.LongType()), T.StructField("_local", T.LongType())])
    rows = materialize(srt.mapInArrow(_numbered(srt.columns.index(group)), schema))
    ends = rows.groupBy("_pid").agg(F.min(F.struct(group)).alias("_first"), F.max(F.struct(group, "_local")).alias("_last"))
    begins = ends.select("_pid", F.lit(0).alias("_at"), F.col(f"_first.{group}").alias("_g"), F.lit(0).cast("long").alias("_n"))
    closes = ends.select("_pid", F.lit(1).alias("_at"), F.col(f"_last.{group}").alias("_g"), (F.col("_last._local") + 1).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_pid", "_at").rowsBetween(Window.unboundedPreceding, -1)
    carry = begins.unionByName(closes).withColumn("_carry", F.sum("_n").over(before)).where("_at = 0 and _carry > 0")
    carried = rows.join(F.broadcast(carry.select("_pid", "_g", "_carry")), "_pid", "left")
    own = F.when(F.col(group).eqNullSafe(F.col("_g")), F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    return carried.withColumn(out, (F.col("_local") + own + 1).cast(out_type)).drop("_pid", "_local", "_g", "_carry")


def _numbered(group_at: int) -> Callable:
    """Task function: sorted rows with the partition's number and their number in the run of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group_at)
            codes = pc.dictionary_encode(g, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.append(True, codes[1:] != codes[:-1])
            local = np.arange(len(codes)) - np.maximum.accumulate(np.where(starts, np.arange(len(codes)), 0))
            if last is not None and last[0].as_py() == g[0].as_py():
                same = len(codes) if starts.sum() == 1 else int(np.flatnonzero(starts)[1])
                local[:same] += n
            last, n = g.slice(len(g) - 1), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(codes), pid)), pa.array(local)], names=[*b.schema.names, "_pid", "_local"])

    return run


def top_k(df: DataFrame, group: str, score: str, key: str, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` candidates per group. ``row_number() <= k`` is planned as a
    partial WindowGroupLimit before the shuffle and a final one after it, so a
    hot group sends at most k rows per map partition."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return rank_candidates(df, group, score, key, out).where(F.col(out) <= k)


def best_rank(df: DataFrame, group: str, score: str, key: str, rel: str = "relevant") -> DataFrame:
    """0-based rank of the best-ranked candidate whose label equals 1.

    The least rank among such candidates, from the segmented scan over the
    four columns; groups without one are left out. Only rows that may stand before a
    group's best one are sorted: a batch's rows behind its own best one are dropped first,
    and what is left is written once.
    """
    from shelfrank.session import materialize, ship_package

    ship_package(df.sparkSession)
    rows = df.select(group, score, key, rel)
    marked = rows.select("*", _ascending(score).alias("_o"), F.coalesce(F.col(rel) == 1, F.lit(False)).alias("_hit"))
    ahead = materialize(marked.mapInArrow(_ahead_of_best, rows.schema))  # the sort's sampling would run the input twice
    ranked = rank_candidates_sorted(ahead, group, score, key, "_rk", keep=[group, rel])
    return ranked.where(F.col(rel) == 1).groupBy(group).agg((F.min("_rk") - 1).cast("int").alias("best_rank"))


def _ahead_of_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over group, score, key, label, ``_o``, ``_hit``: without the rows whose score is below that of
    a hit of their group in the same batch. All that rank before the group's best hit stay, and it itself."""
    for b in batches:
        if not b.num_rows:
            continue
        group = pc.dictionary_encode(b.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        place = np.nan_to_num(b.column(4).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf)
        hit = b.column(5).to_numpy(zero_copy_only=False)
        best = np.full(int(group.max()) + 1, np.inf)
        np.minimum.at(best, group[hit], place[hit])
        yield b.select(range(4)).filter(pa.array(place <= best[group]))


def ranked_relevances(
    df: DataFrame, group: str, score: str, key: str, rel: str = "relevant", chunk: int = 1000
) -> DataFrame:
    """Labels in rank order per group, as bounded chunks of ``chunk`` ranks
    (``group, chunk_no, relevances``). No group is ever collected whole, and
    the ranking itself is the skew-proof sorted form."""
    r = rank_candidates_sorted(df.select(group, score, key, rel), group, score, key, "_rk", keep=[group, rel])
    return (
        r.withColumn("chunk_no", ((F.col("_rk") - 1) / F.lit(chunk)).cast("long").cast("int"))
        .groupBy(group, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_rk"), F.col(rel).alias("r")))).alias("_s"))
        .select(group, "chunk_no", F.transform("_s", lambda x: x["r"]).alias("relevances"))
    )


def first_groups(df: DataFrame, group: str, n: int, where: Column | None = None) -> DataFrame:
    """The first ``n`` group keys in key order (``where`` filters groups
    first, e.g. groups with a positive). Returns one column."""
    g = df.select(group).where(F.col(group).isNotNull())
    if where is not None:
        g = df.where(where).select(group).where(F.col(group).isNotNull())
    return g.distinct().orderBy(group).limit(n)


def ranking_examples(
    df: DataFrame,
    group: str,
    score: str,
    key: str,
    rel: str = "relevant",
    n_groups: int = 3,
    k: int = 10,
    columns: Sequence[str] = ("product_text",),
    nested: bool = False,
) -> DataFrame:
    """For the first ``n_groups`` groups having a positive, their top ``k``.

    Flat: one row per (group, rank). Nested: one row per group with an
    ``array<struct<rank, ..., score, relevant>>`` sorted by rank (at most k).
    """
    has_pos = df.groupBy(group).agg(F.max(F.col(rel)).alias("_mx")).where(F.col("_mx") > 0)
    chosen = has_pos.select(group).orderBy(group).limit(n_groups)
    sel = df.join(chosen, group, "left_semi")
    top = top_k(sel, group, score, key, k, "rank")
    flat = top.select(group, "rank", *columns, score, rel)
    if not nested:
        return flat
    item = F.struct(F.col("rank"), *[F.col(c) for c in columns], F.col(score), F.col(rel))
    return flat.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("products"))
