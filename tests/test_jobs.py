"""The user workflows end to end on files (raw impressions without product_id)."""

import math

from pyspark.sql import functions as F

from conftest import SF01
from shelfrank.operators.encode import HashingEncoder
from shelfrank.operators.judge import stub_judge
from shelfrank.plans import jobs
from shelfrank.schema import EXPERIMENTS, MODEL_ATTRIBUTES
from shelfrank.sources.adapters import impressions


def test_user_workflow(spark, tmp_out):
    raw = f"{tmp_out}/raw.parquet"
    impressions(spark, SF01).drop("product_id").write.parquet(raw)  # a user's file has no product_id

    counts = jobs.prepare_splits(spark, raw, f"{tmp_out}/splits")
    assert set(counts) == {"train", "val", "test"} and sum(counts.values()) == 9781

    jobs.build_catalog(spark, raw, f"{tmp_out}/catalog")
    assert spark.read.parquet(f"{tmp_out}/catalog").count() == 1812

    labels = jobs.explore_language(spark, raw, f"{tmp_out}/de", sample_rows=100)
    assert sum(n for _, n in labels) == 9821 and spark.read.parquet(f"{tmp_out}/de").count() == 100

    top = jobs.keyword_report(spark, f"{tmp_out}/catalog", f"{tmp_out}/kw", ["bolt", "r.ng"])
    assert top.count() > 0 and spark.read.parquet(f"{tmp_out}/kw").count() == 441
    jobs.keyword_report(spark, f"{tmp_out}/catalog", f"{tmp_out}/kw_default")  # default list: no hits in this data
    assert spark.read.parquet(f"{tmp_out}/kw_default").count() == 0

    ts = "2026-01-01T00:00:00"
    m64 = jobs.evaluate_model(spark, f"{tmp_out}/splits", HashingEncoder(64), f"{tmp_out}/results", "hash64", timestamp=ts)
    m32 = jobs.evaluate_model(
        spark, f"{tmp_out}/splits", HashingEncoder(32), f"{tmp_out}/results", "hash32", max_queries=10, limit_stage="before",
        count_api_work=True,
    )
    assert m32["total_api_calls"] == 2 * m32["num_queries_with_positive"]
    assert m64["total_time_sec"] > 0 and m64["queries_evaluated"] > m32["queries_evaluated"]
    assert m32["num_queries_total"] == 10
    assert abs(sum(m64["language_distribution"].asDict().values()) - 1.0) < 1e-9
    for part in ("per_query", "metrics.csv", "examples", "ranks", "relevances"):
        assert spark.read.format("parquet" if part == "ranks" else ("csv" if "csv" in part or part == "per_query" else "json")).option("header", True).load(f"{tmp_out}/results/hash64/{part}").count() > 0

    exps = spark.createDataFrame(
        [(1, "hash64", "hf", "hashing-64", None, "a"), (2, "hash32", "hf", "hashing-32", None, "b")],
        "manifest_order long, " + ", ".join(f"{f.name} string" for f in EXPERIMENTS.fields),
    )
    attrs = spark.createDataFrame([("hashing-64", 0.0, 64, 0)], MODEL_ATTRIBUTES)
    lb = jobs.leaderboard_report(spark, exps, f"{tmp_out}/results", f"{tmp_out}/leaderboard", attrs).collect()
    assert [r["exp_name"] for r in lb] == ["hash64", "hash32"]
    assert all(float(r["queries_per_sec"]) > 0 for r in lb) and lb[0]["embedding_dim"] == "64" and lb[1]["embedding_dim"] is None
    assert lb[0]["texts_per_sec"] is None and float(lb[1]["texts_per_sec"]) > 0

    queries = spark.read.parquet(f"{tmp_out}/splits").where("split = 'test'").select(F.col("OriginalQuery").alias("query")).distinct()
    for dim in (64, 32):
        jobs.search_reports(spark, f"{tmp_out}/catalog", queries, HashingEncoder(dim), f"{tmp_out}/search", k=5,
                            block_text_keywords="anvil,bolt", block_type_keywords="promo")
    sampled = jobs.search_reports(spark, f"{tmp_out}/catalog", queries, HashingEncoder(16), f"{tmp_out}/search_sampled",
                                  k=3, max_products=50)
    assert spark.read.parquet(f"{tmp_out}/search_sampled/hits").select("product_id").distinct().count() <= 50
    hits = spark.read.parquet(f"{tmp_out}/search/hits")
    assert hits.select("model").distinct().count() == 2
    assert hits.where(F.lower("product_text").contains("bolt")).count() == 0
    n_q = queries.count()
    answer = '{"scores":{"model_a":{"relevance":6},"model_b":{"relevance":7}},"overall_better":"model_b"}'
    verdicts = jobs.judge_reports(spark, f"{tmp_out}/search/reports", stub_judge(answer), f"{tmp_out}/verdicts")
    kept = [jobs.judge_reports(spark, f"{tmp_out}/search/reports", judge, f"{tmp_out}/{out}", ledger_path=f"{tmp_out}/ledger")
            for judge, out in ((stub_judge(answer), "kept"), (stub_judge("not asked"), "kept-again"))]
    assert sorted(map(str, kept[1].collect())) == sorted(map(str, verdicts.collect())) == sorted(map(str, kept[0].collect()))
    assert verdicts.where("verdict_file rlike '^judge_.*__.*__vs__.*[.]json$'").count() == n_q
    assert verdicts.count() == n_q and verdicts.where("parsed_ok and overall_better = 'model_b'").count() == n_q

    plan = jobs.training_data(spark, f"{tmp_out}/splits", f"{tmp_out}/train", batch_size=64, epochs=2)
    assert plan["num_training_steps"] == 2 * math.ceil(plan["num_examples"] / 64)
    assert spark.read.parquet(f"{tmp_out}/train/batches").count() == 2 * plan["num_examples"]


def test_catalog_without_text_and_ids(spark, tmp_out):
    """A catalog of names and types alone, with equal rows: search and tagging build what is absent."""
    rows = [("red bolt", "tool"), ("red bolt", "tool"), ("blue ring", None), (None, None)]
    spark.createDataFrame(rows, "ProductName string, ProductType string").write.parquet(f"{tmp_out}/bare")
    jobs.keyword_report(spark, f"{tmp_out}/bare", f"{tmp_out}/kw", ["bolt"])
    assert [r["product_text"] for r in spark.read.parquet(f"{tmp_out}/kw").collect()] == ["red bolt  tool"] * 2
    queries = spark.createDataFrame([("red bolt",)], "query string")
    jobs.search_reports(spark, f"{tmp_out}/bare", queries, HashingEncoder(64), f"{tmp_out}/found", k=4)
    hits = spark.read.parquet(f"{tmp_out}/found/hits").orderBy("rank").collect()
    assert [r["product_text"] for r in hits[:2]] == ["red bolt tool"] * 2 and len({r["product_id"] for r in hits}) == 4
    assert {r["product_text"] for r in hits} == {"red bolt tool", "blue ring", "UNKNOWN_PRODUCT"}
    safe = jobs.search_reports(spark, f"{tmp_out}/bare", queries, HashingEncoder(64), f"{tmp_out}/safe", k=4, block_type_keywords="tool")
    assert "red bolt" not in safe.collect()[0]["report"].split("Text:", 1)[1]


def test_training_data_with_spread_queries(spark, tmp_out):
    rows = [("hot" if i % 2 else f"q{i}", "en", f"p{i}", 1, i) for i in range(200)]
    t = spark.createDataFrame(rows, "OriginalQuery string, PageLanguage string, product_text string, relevant int, product_id long")
    t.withColumn("split", F.lit("train")).write.partitionBy("split").parquet(f"{tmp_out}/splits")
    jobs.training_data(spark, f"{tmp_out}/splits", f"{tmp_out}/out", batch_size=20, epochs=2, spread_queries=True)
    b = spark.read.parquet(f"{tmp_out}/out/batches")
    assert b.count() == 400 and b.where("product_text like 'passage: p%'").count() == 400
    meets = b.groupBy("epoch", "batch_id", "query_text").count()
    assert meets.where("query_text = 'query: hot'").select("count").distinct().collect()[0][0] == 10
    assert meets.where("query_text <> 'query: hot' and count > 1").count() == 0
