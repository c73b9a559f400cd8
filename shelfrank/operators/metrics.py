"""Ranking metrics.

Per query, from candidate rows ``(query, key, score, relevant)``:

* counts per query — one partially aggregated ``groupBy`` (skew-safe);
* the top ``max(ks)`` labels — ``row_number() <= K`` (partial + final
  WindowGroupLimit, so a hot query ships at most K rows per map partition),
  then a bounded ``collect_list`` of at most K entries.

No query's candidate list is ever sorted or collected whole.

Definitions (rank 1-based): hit@k = a label equal to 1 in the top k;
mrr@k = 1/rank of the first label equal to 1 if that rank <= k, else 0;
ndcg@k = DCG over the top-k labels divided by the DCG of those same k labels
sorted descending (truncated ideal); linear gain ``rel`` or exponential gain
``2^rel - 1``; 0 when the ideal is 0. Queries whose labels sum to 0 are left
out of every mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.operators.ranking import top_k

DEFAULT_KS = (1, 5, 10)


def _gain(x: Column, gain: str) -> Column:
    if gain == "linear":
        return x.cast("double")
    if gain == "exponential":
        return F.pow(F.lit(2.0), x.cast("double")) - F.lit(1.0)
    raise ValueError("gain must be 'linear' or 'exponential'")


def _dcg(labels: Column, gain: str) -> Column:
    terms = F.transform(labels, lambda x, i: _gain(x, gain) / F.log2((i + 2).cast("double")))
    return F.aggregate(terms, F.lit(0.0).cast("double"), lambda a, b: a + b)


def ndcg_expr(labels: Column, k: int, gain: str = "linear") -> Column:
    top = F.slice(labels, 1, k)
    ideal = F.sort_array(top, asc=False)
    idcg = _dcg(ideal, gain)
    return F.when(idcg > 0, _dcg(top, gain) / idcg).otherwise(F.lit(0.0))


def query_stats(
    cands: DataFrame,
    query: str,
    key: str,
    score: str = "score",
    rel: str = "relevant",
    ks: Sequence[int] = DEFAULT_KS,
    gain: str = "linear",
) -> DataFrame:
    """Metrics for **every** query (with or without positives)."""
    kmax = max(ks)
    counts = cands.groupBy(query).agg(
        F.count(F.lit(1)).alias("num_products"),
        F.sum(F.col(rel)).cast("bigint").alias("num_positives"),
    )
    top = (
        top_k(cands.select(query, key, score, rel), query, score, key, kmax, "_rk")
        .groupBy(query)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_rk"), F.col(rel).alias("r")))).alias("_top"))
        .select(query, F.transform("_top", lambda x: x["r"]).alias("_labels"))
    )
    j = counts.join(top, query)
    labels = F.col("_labels")
    first_hit = F.array_position(labels, 1)  # 1-based, 0 when absent in the top K
    cols = [F.col(query), F.col("num_products"), F.col("num_positives")]
    for k in ks:
        cols.append(F.when((first_hit > 0) & (first_hit <= k), 1).otherwise(0).alias(f"hit@{k}"))
    for k in ks:
        cols.append(
            F.when((first_hit > 0) & (first_hit <= k), F.lit(1.0) / first_hit.cast("double"))
            .otherwise(F.lit(0.0))
            .alias(f"mrr@{k}")
        )
    for k in ks:
        cols.append(ndcg_expr(labels, k, gain).alias(f"ndcg@{k}"))
    return j.select(*cols)


def per_query_metrics(
    cands: DataFrame,
    query: str,
    key: str,
    score: str = "score",
    rel: str = "relevant",
    ks: Sequence[int] = DEFAULT_KS,
    gain: str = "linear",
    query_alias: str = "query",
) -> DataFrame:
    """H5: the per-query table over queries with at least one positive."""
    s = query_stats(cands, query, key, score, rel, ks, gain).where(F.col("num_positives") > 0)
    metric_cols = [f"hit@{k}" for k in ks] + [f"mrr@{k}" for k in ks] + [f"ndcg@{k}" for k in ks]
    return s.select(F.col(query).alias(query_alias), *metric_cols, "num_products", "num_positives")


def summarize(stats: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """One row — means over evaluated queries plus dataset counts.

    An input without evaluable queries still gives one row, with null means
    (``avg`` of nothing) and ``queries_evaluated`` 0.
    """
    evald = F.col("num_positives") > 0
    metric_cols = [f"hit@{k}" for k in ks] + [f"mrr@{k}" for k in ks] + [f"ndcg@{k}" for k in ks]
    return stats.agg(
        F.count(F.lit(1)).alias("num_queries_total"),
        F.count_if(evald).alias("num_queries_with_positive"),
        F.avg("num_products").alias("avg_products_per_query"),
        F.count_if(evald).alias("queries_evaluated"),
        *[F.avg(F.when(evald, F.col(m).cast("double"))).alias(m) for m in metric_cols],
    )


def evaluate(
    cands: DataFrame,
    query: str,
    key: str,
    score: str = "score",
    rel: str = "relevant",
    ks: Sequence[int] = DEFAULT_KS,
    gain: str = "linear",
) -> DataFrame:
    """Candidates -> one summary row."""
    return summarize(query_stats(cands, query, key, score, rel, ks, gain), ks)


def select_queries(
    cands: DataFrame,
    query: str,
    max_queries: int | None = None,
    limit_stage: str = "after",
    seed: int | None = None,
    rel: str = "relevant",
) -> DataFrame:
    """Restrict candidates to the evaluated queries.

    ``limit_stage="before"``: the first ``max_queries`` queries in key order,
    then the positive filter applies inside the metrics (queries without a
    positive still use up the limit). ``"after"``: the first ``max_queries``
    queries that have a positive. With ``seed``: a seeded shuffle of the
    queries having a positive, first ``max_queries`` (``None`` or <= 0: all).
    """
    from shelfrank.operators.ranking import first_groups
    from shelfrank.operators.sampling import seeded_first_groups

    if limit_stage not in ("before", "after"):
        raise ValueError("limit_stage must be 'before' or 'after'")
    pos = cands.groupBy(query).agg(F.sum(rel).alias("_p")).where(F.col("_p") > 0).select(query)
    if seed is not None:
        keys = seeded_first_groups(pos, query, max_queries, seed)
    elif max_queries is None:
        return cands
    elif limit_stage == "before":
        keys = first_groups(cands, query, max_queries)
    else:
        keys = first_groups(pos, query, max_queries)
    return cands.join(keys, query, "left_semi")


def metrics_long(summary: DataFrame, metrics: Sequence[str] = ("hit@1", "hit@5", "hit@10", "mrr@10", "ndcg@10")) -> DataFrame:
    """The summary as ``metric, value`` rows (unpivot)."""
    return summary.select(*[F.col(f"`{m}`").alias(m) for m in metrics]).unpivot(
        [], [f"`{m}`" for m in metrics], "metric", "value"
    )


def language_distribution(df: DataFrame, lang: str = "PageLanguage") -> DataFrame:
    """Share of each language; null languages are left out of the denominator.
    (The total is a window over the per-language counts — one row per language.)"""
    counts = df.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.col(lang).alias("language"), "n", (F.col("n") / total).alias("share"))


def metrics_document(
    summary: DataFrame, rows: DataFrame | None = None, lang: str = "PageLanguage", **fields
) -> DataFrame:
    """H6 as one document row: the summary, the language shares of ``rows`` as
    ``map<string,double>`` (a scalar subquery over one row per language) and
    literal fields such as ``exp_name``, ``model_name_or_path`` or ``timestamp``
    (passed in, never the clock, so documents are reproducible)."""
    doc = summary
    if rows is not None:
        shares = language_distribution(rows, lang).agg(
            F.map_from_entries(F.collect_list(F.struct("language", "share"))).alias("m")
        )
        doc = doc.withColumn("language_distribution", shares.select("m").scalar())
    for k, v in fields.items():
        doc = doc.withColumn(k, F.lit(v) if v is not None else F.lit(None).cast("string"))
    return doc
