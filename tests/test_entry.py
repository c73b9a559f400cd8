"""Driver contract and the published expected values of the vector fixture."""

import pytest

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and "ndcg@10" in df.columns


def test_expected_summary_sf001(spark):
    r = E.queries()["ranking_metrics"](spark, "/root/testdata/sf0.01").collect()[0]
    assert r["queries_evaluated"] == 43
    assert r["hit@1"] == pytest.approx(0.139535, abs=1e-6)
    assert r["hit@5"] == pytest.approx(0.511628, abs=1e-6)
    assert r["hit@10"] == pytest.approx(0.697674, abs=1e-6)
    assert r["mrr@10"] == pytest.approx(0.297702, abs=1e-6)
    assert r["ndcg@10"] == pytest.approx(0.391975, abs=1e-6)


def test_every_query_has_an_oracle():
    sql = E.oracle_sql()
    assert set(E.REGISTRY) <= set(sql) and set(sql) <= set(E.queries())


def test_pairing_rule_is_an_equi_join():
    for q in range(0, 400, 10):
        for c in range(1, 400):
            assert ((c * 7 + q * 13) % 23 == 0) == (c % 23 == (8 * q) % 23)


def test_adapters_match_published_fixture_statistics(spark):
    """Figures stated in FIXTURES.md for sf0.01 (computed there independently)."""
    from pyspark.sql import functions as F

    from shelfrank.operators.dedup import unique_products
    from shelfrank.operators.judge import parse_verdicts
    from shelfrank.operators.labels import with_block_flags
    from shelfrank.sources.adapters import impressions, judge_responses, judged_vec

    sf = "/root/testdata/sf0.01"
    imp = impressions(spark, sf).cache()
    q = imp.where("OriginalQuery is not null")
    pq = q.groupBy("OriginalQuery").agg(F.count("*").alias("n"), F.sum("UniqueSelects").alias("s"))
    assert (imp.count(), q.count(), pq.count(), pq.where("s = 0").count()) == (9821, 9781, 1910, 88)
    stats = pq.agg(F.round(F.avg("n"), 1).alias("mean"), F.max("n").alias("mx")).first()
    assert (stats["mean"], stats["mx"]) == (5.1, 11)
    nulls = imp.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("BrandName", "Level4_ProductGroup", "ProductType")]).first()
    assert tuple(nulls) == (322, 1408, 821) and imp.where("UniqueSelects > 0").count() == 5791
    cat = unique_products(imp)
    assert cat.count() == 1812
    assert with_block_flags(cat, list("aeiou"), []).where("not blocked").count() == 0  # vowels block everything
    jv = judged_vec(spark, sf)
    pp = jv.groupBy("query_id").agg(F.sum("relevant").alias("p"))
    assert (pp.count(), jv.count(), pp.where("p = 0").count()) == (50, 977, 7)
    v = parse_verdicts(judge_responses(spark, sf)).withColumn("kind", F.col("pair_id") % 11)
    kinds = {r["kind"]: (r["n"], r["ok"], r["scored"]) for r in v.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if("parsed_ok").alias("ok"), F.count("scores_a.relevance").alias("scored")).collect()}
    assert sum(n for n, _, _ in kinds.values()) == 536 and set(kinds) == set(range(11))
    parsed, scored = {0, 1, 2, 6, 10}, {0, 1, 10}  # the others: no JSON, or more than one value, NaN, a key twice
    assert all(ok == n * (k in parsed) and s == n * (k in scored) for k, (n, ok, s) in kinds.items())
    imp.unpersist()


def test_no_registered_query_plans_a_cross_join(spark):
    """Regression guard over all registered queries (plans only, sf0.001)."""
    bad = {}
    for name in E.REGISTRY:
        fn = E.queries()[name]
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if op in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
