"""Metric definitions checked by hand (FIXTURES section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from shelfrank.operators.metrics import evaluate, per_query_metrics, query_stats
from shelfrank.operators.ranking import best_rank, rank_candidates, ranked_relevances, top_k

SCHEMA = "q string, pid long, score double, relevant int"


def cands(spark, labels_by_rank, q="q1"):
    n = len(labels_by_rank)
    rows = [(q, i + 1, float(n - i), lab) for i, lab in enumerate(labels_by_rank)]
    return spark.createDataFrame(rows, SCHEMA)


def stats(spark, labels, gain="linear"):
    return query_stats(cands(spark, labels), "q", "pid", gain=gain).collect()[0].asDict()


def test_metrics_by_hand(spark):
    s = stats(spark, [0, 1, 0, 1])
    assert s["hit@1"] == 0 and s["hit@5"] == 1
    assert s["mrr@10"] == pytest.approx(0.5)
    expect = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert s["ndcg@10"] == pytest.approx(expect)


def test_truncated_ideal(spark):
    labels = [0] * 12
    labels[9] = 1
    labels[11] = 1
    s = stats(spark, labels)
    assert s["ndcg@10"] == pytest.approx((1 / math.log2(11)) / 1.0)


def test_positive_beyond_k(spark):
    labels = [0] * 10 + [1]
    s = stats(spark, labels)
    assert s["hit@10"] == 0 and s["mrr@10"] == 0 and s["ndcg@10"] == 0
    summ = evaluate(cands(spark, labels), "q", "pid").collect()[0]
    assert summ["queries_evaluated"] == 1


def test_no_positives_left_out(spark):
    df = cands(spark, [0, 0, 0], "a").unionByName(cands(spark, [1, 0], "b"))
    summ = evaluate(df, "q", "pid").collect()[0]
    assert summ["queries_evaluated"] == 1 and summ["num_queries_total"] == 2
    assert summ["hit@1"] == 1.0
    pq = per_query_metrics(df, "q", "pid").collect()
    assert [r["query"] for r in pq] == ["b"]


def test_nothing_to_evaluate(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = evaluate(empty, "q", "pid").collect()
    assert len(rows) == 1
    assert rows[0]["queries_evaluated"] == 0 and rows[0]["hit@1"] is None and rows[0]["ndcg@10"] is None


def test_graded_linear_vs_exponential(spark):
    lin = stats(spark, [2, 0, 1], "linear")["ndcg@10"]
    exp = stats(spark, [2, 0, 1], "exponential")["ndcg@10"]
    assert lin == pytest.approx((2 + 1 / math.log2(4)) / (2 + 1 / math.log2(3)))
    assert exp == pytest.approx((3 + 1 / math.log2(4)) / (3 + 1 / math.log2(3)))
    assert lin != pytest.approx(exp)


def test_label_two_only(spark):
    s = stats(spark, [2, 0])
    assert s["num_positives"] == 2 and s["hit@10"] == 0 and s["mrr@10"] == 0


def test_nan_scores_sort_last(spark):
    df = spark.createDataFrame([("q", 1, float("nan"), 0), ("q", 2, 0.1, 0), ("q", 3, 0.9, 1)], SCHEMA)
    r = rank_candidates(df, "q", "score", "pid").orderBy("rank").collect()
    assert [x["pid"] for x in r] == [3, 2, 1]


def test_ties_by_key(spark):
    df = spark.createDataFrame([("q", 5, 0.5, 0), ("q", 2, 0.5, 1), ("q", 9, 0.5, 0)], SCHEMA)
    r = rank_candidates(df, "q", "score", "pid").orderBy("rank").collect()
    assert [x["pid"] for x in r] == [2, 5, 9]


def test_k_above_group_size(spark):
    assert top_k(cands(spark, [1, 0, 0]), "q", "score", "pid", 10).count() == 3
    with pytest.raises(ValueError):
        top_k(cands(spark, [1]), "q", "score", "pid", 0)


def test_best_rank_without_sorting(spark):
    df = cands(spark, [0, 0, 1, 0, 1])
    assert best_rank(df, "q", "score", "pid").collect()[0]["best_rank"] == 2


def test_ranked_relevances_chunks(spark):
    labels = [i % 3 == 0 for i in range(25)]
    df = cands(spark, [int(x) for x in labels])
    rows = ranked_relevances(df, "q", "score", "pid", chunk=10).orderBy("chunk_no").collect()
    assert [len(r["relevances"]) for r in rows] == [10, 10, 5]
    flat = [x for r in rows for x in r["relevances"]]
    assert flat == [int(x) for x in labels]


def test_metrics_unchanged_under_repartition(spark):
    from shelfrank.sources.adapters import judged_vec

    base = judged_vec(spark, "/root/testdata/sf0.01")
    ref = evaluate(base, "query_id", "product_id").collect()[0].asDict()
    for n in (1, 7, 200):
        got = evaluate(base.repartition(n), "query_id", "product_id").collect()[0].asDict()
        for k, v in ref.items():
            assert got[k] == pytest.approx(v), k


def test_metric_bounds_and_order(spark):
    from shelfrank.sources.adapters import judged_vec

    pq = per_query_metrics(judged_vec(spark, "/root/testdata/sf0.01"), "query_id", "product_id").collect()
    for r in pq:
        assert r["hit@1"] <= r["hit@5"] <= r["hit@10"]
        for m in ("mrr@10", "ndcg@10", "ndcg@5"):
            assert 0.0 <= r[m] <= 1.0 + 1e-12


def test_sorted_rank_equals_window_rank_with_hot_group(spark):
    from shelfrank.operators.ranking import rank_candidates_sorted

    rows = [("hot", i, float(i % 7), i % 2) for i in range(3000)]  # many ties, one hot group
    rows += [(f"q{j}", i, float(i), 0) for j in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(13)
    a = rank_candidates(df, "q", "score", "pid").select("q", "pid", "rank")
    b = rank_candidates_sorted(df, "q", "score", "pid").select("q", "pid", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_constant_histogram_middle_bin(spark):
    from shelfrank.operators.profile import class_histogram

    df = spark.createDataFrame([(7.0,)] * 5, "v double")
    r = class_histogram(df, "v", None, 50).collect()
    assert len(r) == 1 and r[0]["bin"] == 25 and r[0]["n"] == 5
    plan = class_histogram(df, "v", None, 50)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _py_metrics(rows, k_list=(1, 5, 10), gain="linear"):
    """Plain-Python metric definitions (reference for the Spark operator)."""
    out = {}
    by_q = {}
    for q, pid, score, rel in rows:
        by_q.setdefault(q, []).append((pid, score, rel))
    for q, items in by_q.items():
        items.sort(key=lambda t: (math.isnan(t[1]), -t[1] if not math.isnan(t[1]) else 0.0, t[0]))
        labels = [r for _, _, r in items]
        first = labels.index(1) + 1 if 1 in labels else None
        g = (lambda x: float(x)) if gain == "linear" else (lambda x: 2.0**x - 1.0)
        m = {"num_products": len(labels), "num_positives": sum(labels)}
        for k in k_list:
            top = labels[:k]
            dcg = sum(g(x) / math.log2(i + 2) for i, x in enumerate(top))
            idcg = sum(g(x) / math.log2(i + 2) for i, x in enumerate(sorted(top, reverse=True)))
            m[f"hit@{k}"] = int(first is not None and first <= k)
            m[f"mrr@{k}"] = 1.0 / first if first is not None and first <= k else 0.0
            m[f"ndcg@{k}"] = dcg / idcg if idcg > 0 else 0.0
        out[q] = m
    return out


@pytest.mark.parametrize("gain", ["linear", "exponential"])
def test_random_queries_match_python_definitions(spark, gain):
    import numpy as np

    rng = np.random.default_rng(11)
    rows = []
    for qi in range(300):
        n = int(rng.integers(1, 30))
        for j in range(n):
            s = float(rng.integers(0, 6)) / 5.0  # many ties
            if rng.random() < 0.05:
                s = float("nan")
            rows.append((f"q{qi}", int(rng.integers(0, 10_000)) * 100 + j, s, int(rng.choice([0, 0, 0, 1, 2]))))
    got = {r["q"]: r.asDict() for r in query_stats(spark.createDataFrame(rows, SCHEMA), "q", "pid", gain=gain).collect()}
    want = _py_metrics(rows, gain=gain)
    assert got.keys() == want.keys()
    for q, m in want.items():
        for key, v in m.items():
            assert got[q][key] == pytest.approx(v, abs=1e-12), (q, key)


def test_select_queries_stages(spark):
    from shelfrank.operators.metrics import select_queries

    df = cands(spark, [0, 0], "a").unionByName(cands(spark, [1, 0], "b")).unionByName(cands(spark, [0, 1], "c"))
    before = {r["q"] for r in select_queries(df, "q", 2, "before").select("q").distinct().collect()}
    after = {r["q"] for r in select_queries(df, "q", 2, "after").select("q").distinct().collect()}
    assert before == {"a", "b"} and after == {"b", "c"}
    assert evaluate(select_queries(df, "q", 2, "before"), "q", "pid").collect()[0]["queries_evaluated"] == 1
    sampled = {r["q"] for r in select_queries(df, "q", 0, seed=42).select("q").distinct().collect()}
    assert sampled == {"b", "c"}


def test_ranking_examples_nested(spark):
    from shelfrank.operators.ranking import ranking_examples

    df = (
        cands(spark, [0] * 12 + [1], "a")
        .unionByName(cands(spark, [0, 0], "b"))
        .unionByName(cands(spark, [1, 0, 1], "c"))
        .unionByName(cands(spark, [1], "d"))
        .unionByName(cands(spark, [1], "e"))
    )
    rows = ranking_examples(df, "q", "score", "pid", columns=("pid",), nested=True).orderBy("q").collect()
    assert [r["q"] for r in rows] == ["a", "c", "d"]  # first three queries having a positive
    assert [p["rank"] for p in rows[0]["products"]] == list(range(1, 11))  # top 10, in rank order
    assert [p["relevant"] for p in rows[1]["products"]] == [1, 0, 1]


def test_hot_query_spreads_over_range_partitions(spark):
    """A query with a third of all rows lands in several partitions of the
    range sort behind rank_candidates_sorted (not in one task)."""
    from shelfrank.operators.ranking import _flag

    rows = [("hot", i, float(i % 97), 0) for i in range(6000)]
    rows += [(f"q{j}", i, float(i), 0) for j in range(1200) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    s = df.withColumn("_f", _flag("score")).withColumn("_s", -F.col("score"))
    parts = (
        s.repartitionByRange(8, "q", "_f", "_s", "pid")
        .where("q = 'hot'")
        .select(F.spark_partition_id().alias("p"))
        .distinct()
        .count()
    )
    assert parts >= 2


def test_scan_carries_groups_over_many_partitions(spark):
    """Half of all rows in one group, null groups, ties; more partitions than rows of most groups."""
    from shelfrank.operators.ranking import rank_candidates_sorted

    rows = [("hot", i, float(i % 5) if i % 11 else None, 1) for i in range(800)] + [(None, i, 1.0, 0) for i in range(60)]
    rows += [(f"q{j}", i, float("nan") if i == 3 else float(i), 0) for j in range(100) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        b = rank_candidates_sorted(df, "q", "score", "pid")
        got = {(r["q"], r["pid"]): r["rank"] for r in b.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = {(r["q"], r["pid"]): r["rank"] for r in rank_candidates(df, "q", "score", "pid").collect()}
    assert got == want


@pytest.mark.parametrize("name", ["rank_candidates_sorted", "ranked_relevances", "best_rank"])
def test_rankings_join_nothing_on_the_group(spark, name):
    from shelfrank.operators import ranking

    df = spark.createDataFrame([("a", i, float(i), i % 2) for i in range(50)], SCHEMA)
    plan = getattr(ranking, name)(df, "q", "score", "pid")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_pid" in line and "q#" not in line for line in joins)


def test_best_rank_sorts_only_rows_ahead_of_a_hit(spark):
    """One query, every third candidate relevant: of 3000 rows a batch keeps those down to its first hit."""
    import pyarrow as pa

    from shelfrank.operators.ranking import _ahead_of_best

    rows = [("q", -o, i, int(i % 3 == 2), o, i % 3 == 2) for i, o in enumerate(map(float, range(3000)))]
    batch = pa.RecordBatch.from_pylist([dict(zip("gskroh", r, strict=True)) for r in rows])
    [kept] = _ahead_of_best([batch])
    assert kept.column(2).to_pylist() == [0, 1, 2] and kept.schema.names == list("gskr")


def test_best_rank_equals_the_windows_least_rank(spark):
    """Null and NaN scores, infinities, null groups and labels, ties; batches of 7 rows."""
    scores = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, 2.0]
    rows = [(("a", "b", None, "c")[i % 4], i, scores[(i * 7) % 8], (0, 0, 1, None, 0)[i % 5] if i % 4 < 3 else 0) for i in range(400)]
    rows += [("late", i, float("nan") if i < 5 else None, int(i == 8)) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ranked = rank_candidates(df, "q", "score", "pid").where("relevant = 1").collect()
    want = {r["q"]: min(x["rank"] for x in ranked if x["q"] == r["q"]) - 1 for r in ranked}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = {r["q"]: r["best_rank"] for r in best_rank(df, "q", "score", "pid").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want and set(got) == {"a", "b", None, "late"}


@pytest.mark.parametrize("graded", [False, True])
def test_judged_pairs_are_the_ordered_sums_of_all_pairs(spark, tmp_out, graded):
    """Odd vectors and labels, ids twice; scores equal the row-wise dot bit for bit, and no pair carries vectors."""
    import random

    from shelfrank.functions.vectors import dot
    from shelfrank.sources.adapters import judged_vec

    rng = random.Random(5)
    rows = [(i - 30, [rng.gauss(0, 1) for _ in range(7)], i % 4) for i in range(400)]
    for i, vec in enumerate([None, [], [1.0], [None] * 7, [float("nan")] * 7, [float("inf")] * 7, [0.0] * 6 + [None]]):
        rows += [(1000 + j, vec, (None, 1)[i % 2]) for j in range(i * 23, i * 23 + 23)]
    rows += rows[:40] + [(None, [1.0] * 7, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_out}/embeddings.parquet")
    e = spark.read.parquet(f"{tmp_out}/embeddings.parquet")
    q, c = (e.select(*[F.col(x).alias(f"{s}_{x}") for x in e.columns]) for s in "qc")
    p = q.join(c, F.expr("q_vec_id % 10 = 0 and c_vec_id % 10 <> 0 and (c_vec_id * 7 + q_vec_id * 13) % 23 = 0"))
    rel = F.when(F.expr("q_label = c_label"), 2 if graded else 1).when(F.expr("abs(q_label - c_label) = 1"), int(graded)).otherwise(0)
    want = p.select("q_vec_id", "c_vec_id", dot("c_embedding", "q_embedding"), rel)
    got = judged_vec(spark, tmp_out, graded)
    assert got.dtypes == [("query_id", "bigint"), ("product_id", "bigint"), ("score", "double"), ("relevant", "int")]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.toDF(*got.columns).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "zip_with" not in plan
