"""Model comparison: leaderboard from experiments and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.schema import LEADERBOARD_COLUMNS

LOCAL_PROVIDER = "local"  # provider shown when an experiment names none


def throughput(num: Column, total_time: Column) -> tuple[Column, Column]:
    """Per second and per minute; null when time is null or not positive,
    or the count is null or 0."""
    ok = total_time.isNotNull() & (total_time > 0) & num.isNotNull() & (num != 0)
    per_sec = F.when(ok, num.cast("double") / total_time)
    return per_sec, per_sec * F.lit(60.0)


def texts_throughput(texts: Column, total_time: Column) -> tuple[Column, Column]:
    """J1 for texts: null when texts are null or time is null / not positive."""
    ok = texts.isNotNull() & total_time.isNotNull() & (total_time > 0)
    per_sec = F.when(ok, texts.cast("double") / total_time)
    return per_sec, per_sec * F.lit(60.0)


def throughput_rows(metrics: DataFrame) -> DataFrame:
    """J1 for every metrics document: queries and texts a second and a minute."""
    nq, tt, texts = F.col("num_queries"), F.col("total_time_sec"), F.col("total_texts_embedded")
    qps, qpm = throughput(nq, tt)
    tps, tpm = texts_throughput(texts, tt)
    return metrics.select(
        "exp_name", nq, tt, texts, qps.alias("queries_per_sec"), qpm.alias("queries_per_min"), tps.alias("texts_per_sec"), tpm.alias("texts_per_min")
    )


def leaderboard(experiments: DataFrame, metrics: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row per experiment with the 20 leaderboard columns, plus
    ``manifest_order`` (taken from the manifest when present).

    * E5: every experiment needs a metrics row — a missing one fails the job
      (``raise_error``) naming the experiment.
    * E6: parameters/dimension/layers from ``attributes`` for ``kind = 'hf'``
      only; null when unknown.
    """
    exp = experiments
    if "manifest_order" not in exp.columns:
        exp = exp.withColumn("manifest_order", F.monotonically_increasing_id())
    m = metrics.select(
        "exp_name",
        *[F.col(f"`{c}`") for c in ("hit@1", "hit@5", "hit@10", "mrr@10", "ndcg@10")],
        "num_queries",
        "total_time_sec",
        "total_texts_embedded",
    ).withColumn("_has_metrics", F.lit(True))
    j = exp.join(m, "exp_name", "left")
    checked = j.withColumn(
        "_check",
        F.when(
            F.col("_has_metrics").isNull(),
            F.raise_error(F.concat(F.lit("metrics not found for experiment "), F.col("exp_name"))),
        ),
    )
    if attributes is not None:
        attrs = attributes.select(
            F.col("model_id").alias("_am"), "params_millions", "embedding_dim", "num_layers"
        )
        checked = checked.join(
            attrs, (F.col("kind") == F.lit("hf")) & (F.col("model_id") == F.col("_am")), "left"
        ).drop("_am")
    else:
        for c, t in (("params_millions", "double"), ("embedding_dim", "int"), ("num_layers", "int")):
            checked = checked.withColumn(c, F.lit(None).cast(t))
    nq, tt = F.col("num_queries"), F.col("total_time_sec")
    qps, qpm = throughput(nq, tt)
    tps, tpm = texts_throughput(F.col("total_texts_embedded"), tt)
    out = checked.select(
        "manifest_order",
        "_check",
        "exp_name",
        "kind",
        F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit(LOCAL_PROVIDER)).alias("provider"),
        "model_id",
        "note",
        F.col("`hit@1`"),
        F.col("`hit@5`"),
        F.col("`hit@10`"),
        F.col("`mrr@10`"),
        F.col("`ndcg@10`"),
        nq.alias("num_queries"),
        tt.alias("total_time_sec"),
        qps.alias("queries_per_sec"),
        qpm.alias("queries_per_min"),
        F.col("total_texts_embedded"),
        tps.alias("texts_per_sec"),
        tpm.alias("texts_per_min"),
        "params_millions",
        "embedding_dim",
        "num_layers",
    )
    # _check is null for good rows; keeping it in the plan forces evaluation.
    return out.where(F.col("_check").isNull()).select("manifest_order", *[F.col(f"`{c}`") for c in LEADERBOARD_COLUMNS])
