"""M1: arriving queries -> top-k from a static catalog (Structured Streaming).

The catalog vectors are computed once and **written** to the shared
checkpoint folder (cutting their lineage), then every micro-batch reads them
back and runs the same blocked top-k as the batch search. Output rows are
keyed by (batch_id, conv_id, turn, rank) and each micro-batch overwrites only
its own ``batch_id`` partition, so a replayed batch (foreachBatch is
at-least-once) replaces its earlier output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.text import QUERY_PREFIX, ustrip, with_prefix
from shelfrank.functions.vectors import squared_norm
from shelfrank.operators.search import catalog_topk
from shelfrank.sources.tables import BASE_SCHEMAS


# Rows of the sink (``batch_id`` is its partition column); a sink without rows has no file to tell them.
HITS = "query string, conv_id bigint, turn bigint, product_id bigint, score double, rank int, batch_id int"


def conversation_queries(stream: DataFrame) -> DataFrame:
    """User turns as queries; blank ones are skipped."""
    return (
        stream.where(F.col("role") == "user")
        .withColumn("query", ustrip("text"))
        .where(F.col("query").isNotNull() & (F.col("query") != ""))
        .select("conv_id", "turn", "query")
    )


def search_batch(batch: DataFrame, catalog_vecs: DataFrame, encoder, k: int) -> DataFrame:
    """Top-k for one micro-batch of queries (distinct query texts encoded once)."""
    qs = batch.select("query").distinct()
    qv = encoder.encode(qs.withColumn("_t", with_prefix(QUERY_PREFIX, "query")), "_t", "q_emb")
    qv = qv.select("query", "q_emb", squared_norm("q_emb").alias("q_sq"))
    hits = catalog_topk(qv, catalog_vecs, k, "query", "product_id", normalized=encoder.normalized)
    return batch.join(hits, "query")


def write_batch(batch_df: DataFrame, batch_id: int, catalog_path: str, encoder, k: int, sink_path: str) -> None:
    """One micro-batch: search its queries and overwrite only the partition
    ``batch_id=<id>`` of the sink (a replay of the same batch replaces it)."""
    cat = batch_df.sparkSession.read.parquet(catalog_path)
    out = search_batch(batch_df, cat, encoder, k).withColumn("batch_id", F.lit(batch_id).cast("long"))
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(sink_path)
    )


def run_stream_search(
    spark: SparkSession,
    source_dir: str,
    file_glob: str,
    catalog_vecs: DataFrame,
    encoder,
    k: int,
    sink_path: str,
    checkpoint_path: str,
    catalog_path: str,
    available_now: bool = True,
    files_per_batch: int | None = 1,
):
    """Start the streaming search; with ``available_now`` it processes what is
    there and stops. ``files_per_batch`` None puts all files there into one micro-batch.
    Returns the finished (or running) StreamingQuery."""
    catalog_vecs.select("product_id", "p_emb", "p_sq").write.mode("overwrite").parquet(catalog_path)

    reader = spark.readStream.schema(BASE_SCHEMAS["conversations"]).option("pathGlobFilter", file_glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    queries = conversation_queries(reader.parquet(source_dir))

    def per_batch(batch_df: DataFrame, batch_id: int) -> None:
        write_batch(batch_df, batch_id, catalog_path, encoder, k, sink_path)

    writer = queries.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
