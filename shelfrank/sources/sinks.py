"""Readers and writers of result artifacts.

Everything is written by executors in parallel; nothing is gathered on the
driver. Tables are parquet unless the artifact is meant for people (CSV/JSON).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.operators.metrics import metrics_long
from shelfrank.schema import METRICS_DOC


def write_splits(split_rows: DataFrame, path: str) -> None:
    """All splits in one pass, one folder per split (``split=train`` ...);
    a later read with ``where split = 'test'`` prunes the other folders."""
    split_rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, replace_partitions_only: bool = False) -> None:
    """A6 generic parquet sink (catalog, samples, keyword hits, hits tables).
    ``replace_partitions_only`` overwrites just the partitions being written
    (e.g. one model's hits next to another's)."""
    w = df.write.mode("overwrite")
    if replace_partitions_only:
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_metrics_csv(summary: DataFrame, path: str) -> None:
    """The long ``metric,value`` table as CSV with a header."""
    metrics_long(summary).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Per-query metrics, leaderboard."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (metrics documents, examples, verdicts, run plans)."""
    df.write.mode("overwrite").json(path)


def write_metrics_doc(summary: DataFrame, path: str, **fields) -> None:
    """One metrics document (one JSON object) with extra literal fields
    such as ``exp_name``, ``model`` or ``total_time_sec``."""
    doc = summary
    for k, v in fields.items():
        doc = doc.withColumn(k, F.lit(v))
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_docs(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """A4: read metrics documents of many experiments (all three writer
    variants; absent keys are null). The experiment defaults to the name of
    the folder holding ``metrics.json`` when the document has none.
    ``multi_line=False`` reads files of one document a line, which Spark can split."""
    df = spark.read.schema(METRICS_DOC).option("multiLine", multi_line).json(pattern)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/metrics\.json(/[^/]*)?$", 1)
    return df.withColumn("exp_name", F.coalesce(F.col("exp_name"), F.nullif(folder, F.lit(""))))


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A5: each file as one row ``path, text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Report texts, one folder per model (``model=...``); writing one
    model's reports leaves the other models' folders in place."""
    (
        reports.select("model", "query", "report")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .json(path)
    )


def write_training_batches(batches: DataFrame, path: str) -> None:
    """One folder per epoch; rows of a batch together and in position
    order, so a trainer streams batches in sequence."""
    (
        batches.repartition("epoch", "batch_id")
        .sortWithinPartitions("epoch", "batch_id", "position")
        .write.mode("overwrite")
        .partitionBy("epoch")
        .parquet(path)
    )


def write_ranks(per_query: DataFrame, path: str) -> None:
    """Best ranks as an int column of the per-query parquet."""
    per_query.write.mode("overwrite").parquet(path)
