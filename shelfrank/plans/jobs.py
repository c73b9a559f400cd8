"""End-to-end jobs over files: the workflows a user runs, composed from operators.

Each job reads its inputs with Spark, runs the operators as distributed plans
and writes its artifacts with the sinks. Jobs are where actions happen (writes,
one-row counts, wall-clock timing); operators stay lazy.

| Job | Reads | Writes |
|---|---|---|
| :func:`prepare_splits` | impressions parquet | ``split=train|val|test`` parquet, returns row counts |
| :func:`build_catalog` | impressions parquet | unique products parquet |
| :func:`explore_language` | impressions parquet | label counts + exact-size language sample |
| :func:`keyword_report` | catalog parquet | keyword hits parquet + top type/group values |
| :func:`evaluate_model` | split parquet | metrics document, metrics CSV, per-query CSV, examples, ranks, relevances |
| :func:`leaderboard_report` | metrics documents | leaderboard CSV |
| :func:`search_reports` | catalog parquet + queries | hit table and text reports per model |
| :func:`judge_reports` | two models' reports | verdicts JSON |
| :func:`training_data` | split parquet | shuffled batches + run plan |
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.functions.text import DEFAULT_TAG_KEYWORDS, parse_keywords
from shelfrank.operators.compare import leaderboard
from shelfrank.operators.dedup import unique_products
from shelfrank.operators.judge import JudgeSettings, ask_judge, judge_prompts, judgement_file_name, pair_reports, parse_verdicts, report_file_stem
from shelfrank.operators.judge_ledger import ask_judge_once
from shelfrank.operators.labels import judged_table, keyword_hits, language_rows, with_block_flags, with_label, with_product_text
from shelfrank.operators.metrics import metrics_document, query_stats, select_queries, summarize
from shelfrank.operators.profile import encoding_workload, label_counts, top_values
from shelfrank.operators.ranking import best_rank, ranked_relevances, ranking_examples
from shelfrank.operators.sampling import exact_sample
from shelfrank.operators.search import catalog_topk, safe_catalog, search_report
from shelfrank.operators.splits import assign_splits
from shelfrank.operators.training import spread_batches, training_batches, training_pairs, training_plan
from shelfrank.plans.build import catalog_vectors, query_vectors, scored_text_candidates
from shelfrank.schema import IMPRESSIONS, require_columns
from shelfrank.session import materialize
from shelfrank.sources import sinks

RAW_COLUMNS = ("OriginalQuery", "PageLanguage", "ProductName", "BrandName", "Level4_ProductGroup", "ProductType", "UniqueSelects")


def read_impressions(spark: SparkSession, path: str) -> DataFrame:
    """A1 + A2: the raw impressions file. Without a ``product_id`` column a
    deterministic one is derived from the row content (the stated order for
    keep-first dedup and ties; a file has no order Spark could keep)."""
    df = spark.read.parquet(path)
    require_columns(df, RAW_COLUMNS)
    if "product_id" not in df.columns:
        df = df.withColumn("product_id", F.xxhash64(*[F.col(c) for c in RAW_COLUMNS]))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in IMPRESSIONS.fields])


CATALOG_PARTS = ("ProductName", "BrandName", "ProductType", "Level4_ProductGroup")


def read_catalog(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """A1 + B2 + B13: a catalog file. Absent name, brand, type and group columns
    are null, an absent ``product_text`` is built as ``variant``, and an absent
    ``product_id`` is a hash of the row's content and its number among equal rows."""
    df = spark.read.parquet(path)
    for c in CATALOG_PARTS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "product_text" not in df.columns:
        df = with_product_text(df, variant)
    if "product_id" not in df.columns:
        parts = [F.col(c) for c in (*CATALOG_PARTS, "product_text")]
        df = df.withColumn("_content", F.xxhash64(*parts, *[c.isNull() for c in parts]))
        same = Window.partitionBy("_content").orderBy("_content")
        df = df.withColumn("product_id", F.xxhash64("_content", F.row_number().over(same))).drop("_content")
    return df


def prepare_splits(spark: SparkSession, impressions_path: str, out_path: str, seed: int = 42) -> dict[str, int]:
    """C4 + A6: label, text, clean, split by query; one write, one folder per split."""
    judged = materialize(judged_table(read_impressions(spark, impressions_path)))
    sinks.write_splits(assign_splits(judged, seed=seed), out_path)
    counts = spark.read.parquet(out_path).groupBy("split").count().collect()
    return {r["split"]: r["count"] for r in counts}


def build_catalog(spark: SparkSession, impressions_path: str, out_path: str) -> None:
    """C1 + A6: unique products by name / brand / type."""
    sinks.write_parquet(unique_products(read_impressions(spark, impressions_path)), out_path)


def explore_language(
    spark: SparkSession, impressions_path: str, out_path: str, lang: str = "de", sample_rows: int = 200_000, seed: int = 42
) -> list[tuple[int, int]]:
    """D2 + B6 + C5: label counts of all rows; an exact-size seeded sample of one
    language (explore text variant) written to ``out_path``."""
    df = with_product_text(with_label(read_impressions(spark, impressions_path)), "explore")
    counts = [(r["relevant"], r["n"]) for r in label_counts(df).orderBy("relevant").collect()]
    sinks.write_parquet(exact_sample(language_rows(df, lang), sample_rows, ["product_id", "OriginalQuery"], seed), out_path)
    return counts


def keyword_report(
    spark: SparkSession, catalog_path: str, out_path: str, keywords: Sequence[str] = DEFAULT_TAG_KEYWORDS
) -> DataFrame:
    """B8 + D9: products matching any keyword (regex), written; returns the top
    20 types and groups among them."""
    hits = materialize(keyword_hits(read_catalog(spark, catalog_path, "catalog"), list(keywords)))
    sinks.write_parquet(hits, out_path)
    return top_values(hits, "ProductType", 20).unionByName(top_values(hits, "Level4_ProductGroup", 20))


def evaluate_model(
    spark: SparkSession,
    split_path: str,
    encoder,
    out_dir: str,
    exp_name: str,
    split: str = "test",
    ks: Sequence[int] = (1, 5, 10),
    gain: str = "linear",
    max_queries: int | None = None,
    limit_stage: str = "after",
    sample_seed: int | None = None,
    timestamp: str | None = None,
    count_api_work: bool = False,
) -> dict:
    """H1–H6 + A7 + A8 + A9 + G4–G6: evaluate one encoder on one split.

    Writes ``metrics.json`` (summary, dataset counts, language map, run time),
    ``metrics.csv`` (long), ``per_query`` CSV, ``examples`` JSON (first three
    queries with a positive, top 10), ``ranks`` parquet (best rank per query)
    and ``relevances`` JSON (labels in rank order, in chunks). Returns the
    summary as a dict. ``total_time_sec`` is the wall-clock time of the job.
    With ``count_api_work`` the document also carries the per-query embedding
    work counters (``total_api_calls``, ``total_texts_embedded``).
    """
    t0 = time.perf_counter()
    rows = sinks.read_split(spark, split_path, split)
    rows = select_queries(rows, "OriginalQuery", max_queries, limit_stage, sample_seed)
    scored = materialize(scored_text_candidates(rows, encoder))
    stats = materialize(query_stats(scored, "OriginalQuery", "product_id", ks=ks, gain=gain))
    summary = summarize(stats, ks)
    per_query = stats.where(F.col("num_positives") > 0).withColumnRenamed("OriginalQuery", "query")
    sinks.write_csv(per_query, f"{out_dir}/{exp_name}/per_query")
    sinks.write_metrics_csv(summary, f"{out_dir}/{exp_name}/metrics.csv")
    sinks.write_json(
        ranking_examples(scored, "OriginalQuery", "score", "product_id", nested=True), f"{out_dir}/{exp_name}/examples"
    )
    sinks.write_ranks(best_rank(scored, "OriginalQuery", "score", "product_id"), f"{out_dir}/{exp_name}/ranks")
    sinks.write_json(ranked_relevances(scored, "OriginalQuery", "score", "product_id"), f"{out_dir}/{exp_name}/relevances")
    elapsed = time.perf_counter() - t0
    doc = metrics_document(
        summary.withColumn("num_queries", F.col("queries_evaluated")),
        rows,
        exp_name=exp_name,
        model=encoder.model_id,
        test_file=split_path,
        timestamp=timestamp,
        total_time_sec=elapsed,
    )
    if count_api_work:
        work = encoding_workload(rows)
        doc = doc.withColumn("total_api_calls", work.select("total_api_calls").scalar()).withColumn(
            "total_texts_embedded", work.select("total_texts_embedded").scalar()
        )
    sinks.write_json(doc.coalesce(1), f"{out_dir}/{exp_name}/metrics.json")
    return spark.read.json(f"{out_dir}/{exp_name}/metrics.json").collect()[0].asDict()


def leaderboard_report(
    spark: SparkSession, experiments: DataFrame, results_dir: str, out_path: str, attributes: DataFrame | None = None
) -> DataFrame:
    """A4 + E5 + E6 + J1 + J2 + A13: read every experiment's metrics document,
    build the leaderboard (a missing document fails the job), write it as CSV."""
    docs = sinks.read_metrics_docs(spark, f"{results_dir}/*/metrics.json/*.json")
    lb = leaderboard(experiments, docs, attributes).orderBy("manifest_order")
    sinks.write_csv(lb.coalesce(1), out_path)
    return spark.read.option("header", True).csv(out_path)


def search_reports(
    spark: SparkSession,
    catalog_path: str,
    queries: DataFrame,
    encoder,
    out_dir: str,
    k: int = 5,
    block_text_keywords: str | Sequence[str] | None = None,
    block_type_keywords: str | Sequence[str] | None = None,
    max_products: int | None = None,
    seed: int = 42,
    cache_path: str | None = None,
) -> DataFrame:
    """G2/G3 + A11: top-k of the whole catalog for every query (column
    ``query``), with optional blocklists and the all-blocked fallback; writes
    the hit table and one text report per query under ``model=<model_id>``.

    ``max_products`` searches an exact-size seeded sample of the catalog
    instead (C5; the interactive tool defaulted to
    ``REFERENCE_SEARCH_MAX_PRODUCTS``); by default the whole catalog is searched.
    ``cache_path`` keeps the catalog's vectors from run to run (A10).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    tkw, ykw = parse_keywords(block_text_keywords), parse_keywords(block_type_keywords)
    safe = bool(tkw or ykw)
    catalog = read_catalog(spark, catalog_path, "search_safe" if safe else "search")
    if max_products is not None:
        catalog = exact_sample(catalog, max_products, ["product_id"], seed)
    if safe:
        catalog = safe_catalog(with_block_flags(catalog, tkw, ykw))
    catalog = materialize(catalog)
    judged_like = queries.select(F.col("query").alias("OriginalQuery"))
    hits = catalog_topk(
        query_vectors(judged_like, encoder), catalog_vectors(catalog, encoder, cache_path), k, "query", "product_id",
        normalized=encoder.normalized,
    )
    attrs = catalog.select("product_id", "product_text", "ProductName", "BrandName", "ProductType", "Level4_ProductGroup")
    full = hits.join(attrs, "product_id").withColumn("model", F.lit(encoder.model_id))
    full = materialize(full)
    sinks.write_parquet(full, f"{out_dir}/hits", partition_by=["model"], replace_partitions_only=True)
    reports = search_report(full, "query", "model", safe=safe, text_keywords=tkw, type_keywords=ykw)
    sinks.write_reports(reports, f"{out_dir}/reports")
    return reports


def judge_reports(
    spark: SparkSession, reports_path: str, judge_fn: Callable[[list[str], JudgeSettings], list[str]], out_path: str,
    settings: JudgeSettings = JudgeSettings(), ledger_path: str | None = None,
) -> DataFrame:
    """E7 + K1–K5: pair the models' reports of each query, ask the judge in
    batches, parse the verdicts and write them as JSON, each with the name of
    its verdict file (K6). With ``ledger_path`` answers are kept there, and what
    it has is not asked again."""
    reports = spark.read.json(reports_path)
    prompts = judge_prompts(pair_reports(reports))
    if ledger_path is None:
        answered = ask_judge(prompts, judge_fn, settings=settings)
    else:
        answered = ask_judge_once(prompts, judge_fn, ledger_path, settings=settings).drop("reused")
    verdicts = parse_verdicts(answered)
    stem = report_file_stem(F.col("query"))
    verdicts = verdicts.withColumn("verdict_file", judgement_file_name(F.col("query"), stem, stem))
    sinks.write_json(verdicts.drop("prompt"), out_path)
    return spark.read.json(out_path)


def training_data(
    spark: SparkSession,
    split_path: str,
    out_path: str,
    batch_size: int = 256,
    epochs: int = 1,
    max_rows: int | None = None,
    seed: int = 42,
    spread_queries: bool = False,
) -> dict:
    """Positive (query, passage) pairs of the train split, shuffled
    batches per epoch (written), and the run plan (returned and written).
    With ``spread_queries`` no batch holds a query twice unless its pairs
    outnumber the batches; the texts join the finished assignment."""
    pairs = materialize(training_pairs(sinks.read_split(spark, split_path, "train"), split=None, max_rows=max_rows, seed=seed, keep_key=True))
    if spread_queries:
        places = spread_batches(pairs, batch_size, epochs, seed).drop("query_text")
        batches = places.join(pairs, "pair_key").withColumnRenamed("slot", "position")
    else:
        batches = training_batches(pairs, batch_size, epochs, seed)
    sinks.write_training_batches(batches, f"{out_path}/batches")
    plan = training_plan(pairs, batch_size, epochs)
    sinks.write_json(plan.coalesce(1), f"{out_path}/plan")
    return plan.collect()[0].asDict()
