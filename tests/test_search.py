"""Catalog search: brute force agreement, block independence, blocklists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators.labels import with_block_flags
from shelfrank.operators.search import catalog_topk, deal, safe_catalog
from shelfrank.operators.slot_index import SlotIndex

RNG = np.random.default_rng(7)


def frames(spark, nq=13, npr=40, dim=6, ints=True):
    qv = RNG.integers(0, 3, size=(nq, dim)) if ints else RNG.normal(size=(nq, dim))
    pv = RNG.integers(0, 3, size=(npr, dim)) if ints else RNG.normal(size=(npr, dim))
    qv, pv = qv.astype(np.float32).astype(float), pv.astype(np.float32).astype(float)  # stored as float
    if npr > 6:
        pv[5] = pv[6]  # exact tie
    q = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in qv[i]], float(qv[i] @ qv[i])) for i in range(nq)], "query string, q_emb array<float>, q_sq double"
    )
    p = spark.createDataFrame(
        [(100 - j, [float(x) for x in pv[j]], float(pv[j] @ pv[j])) for j in range(npr)], "product_id long, p_emb array<float>, p_sq double"
    )
    return q, p, qv.astype(float), pv.astype(float)


def brute(qv, pv, k, keys, cosine=True):
    out = {}
    for i in range(len(qv)):
        s = pv @ qv[i]
        if cosine:
            den = np.sqrt(qv[i] @ qv[i]) * np.sqrt(np.sum(pv * pv, axis=1))
            s = np.where(den > 0, s / np.where(den > 0, den, 1), 0.0)
        order = sorted(range(len(pv)), key=lambda j: (-s[j], keys[j]))[:k]
        out[f"q{i}"] = [(keys[j], round(float(s[j]), 9)) for j in order]
    return out


def collect(hits):
    got = {}
    for r in hits.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["product_id"], round(r["score"], 9)))
    return got


@pytest.mark.parametrize("qb,cb", [(1024, 8192), (3, 4), (1, 1)])
def test_topk_matches_brute_force_any_blocking(spark, qb, cb):
    q, p, qv, pv = frames(spark)
    keys = [100 - j for j in range(len(pv))]
    hits = catalog_topk(q, p, 5, "query", "product_id", normalized=False, query_block_rows=qb, catalog_block_rows=cb)
    assert collect(hits) == brute(qv, pv, 5, keys)


def test_topk_dot_and_small_catalog(spark):
    q, p, qv, pv = frames(spark, nq=4, npr=3, ints=False)
    hits = catalog_topk(q, p, 10, "query", "product_id", normalized=True)
    assert hits.groupBy("query").count().where("count != 3").count() == 0
    keys = [100 - j for j in range(3)]
    assert collect(hits) == brute(qv, pv, 10, keys, cosine=False)


def test_more_queries_than_products_copies_products(spark):
    q, p, qv, pv = frames(spark, nq=90, npr=25)
    keys = [100 - j for j in range(len(pv))]
    for block in (65_536, 7):
        hits = catalog_topk(q, p, 4, "query", "product_id", normalized=False, query_block_rows=block)
        assert collect(hits) == brute(qv, pv, 4, keys)


def test_null_vectors_rank_last(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query string, q_emb array<float>")
    p = spark.createDataFrame([(1, None), (2, [0.5, 0.0]), (3, [-0.9, 0.0]), (0, None)], "product_id long, p_emb array<float>")
    hits = catalog_topk(q, p, 3).collect()
    assert [r["product_id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query"] == "q"] == [2, 3, 0]
    assert [r["product_id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query"] == "none"] == [0, 1, 2]


def _token_vectors(n, rng, words):
    out = np.zeros((n, 64))
    for row in out:
        np.add.at(row, rng.integers(0, 64, words), 1)
        row[:2] += 1
    return out


@pytest.mark.parametrize("cosine", [True, False])
def test_index_scores_under_a_fifth_of_the_pairs(cosine):
    """Sparse count vectors as the hashing encoder makes them; results equal all scores sorted."""
    rng = np.random.default_rng(3)
    p, q = _token_vectors(6000, rng, 6), _token_vectors(80, rng, 3)
    p[17] = np.nan
    codes = rng.permutation(len(p))
    ps, qs = (p * p).sum(axis=1), (q * q).sum(axis=1)
    index = SlotIndex(p, codes, ps if cosine else None)
    for i in range(len(q)):
        s = p @ q[i]
        s = s / (np.sqrt(qs[i]) * np.sqrt(ps)) if cosine else s
        order = np.lexsort((codes, -np.where(np.isnan(s), -np.inf, s), np.isnan(s)))[:10]
        _, rows, scores = index.top(q[i : i + 1], qs[i : i + 1], 10)
        np.testing.assert_array_equal(rows, order)
        np.testing.assert_array_equal(scores, s[order])
    assert index.scored < 0.2 * len(q) * len(p)


@pytest.mark.parametrize("k", [1, 7, 400])
def test_index_with_negative_entries_floors_and_lost_vectors(k):
    rng = np.random.default_rng(k)
    p, q = rng.normal(size=(301, 5)), rng.normal(size=(20, 5))
    p[[7, 8]] = np.nan
    p[9] = 0.0
    codes = rng.permutation(301)
    ps = (p * p).sum(axis=1)
    index = SlotIndex(p, codes, ps)
    for v in q:
        den = np.sqrt(v @ v) * np.sqrt(ps)
        s = np.where(den > 0, p @ v / np.where(den > 0, den, 1), np.where(np.isnan(den), np.nan, 0.0))
        order = np.lexsort((codes, -np.where(np.isnan(s), -np.inf, s), np.isnan(s)))[:k]
        _, rows, scores = index.top(v[None, :], np.array([v @ v]), k)
        np.testing.assert_array_equal(rows, order)
        np.testing.assert_allclose(scores, s[order], rtol=1e-12, atol=1e-12)
        _, some, _ = index.top(v[None, :], np.array([v @ v]), k, floors=np.array([0.3]))
        assert set(some) == {r for r in order if s[r] >= 0.3}


def test_larger_side_is_shuffled_once_whatever_the_parallelism(spark):
    q = spark.createDataFrame([(f"q{i}", [1.0], 1.0) for i in range(5)], "qk string, vec array<double>, sq double")
    p = spark.range(20_000).select(F.col("id").alias("pk"), F.array(F.lit(1.0)).alias("vec"), F.lit(1.0).alias("sq"))
    for slots in (1, 8, 64):
        rows = deal(q, p, slots, 65_536, 131_072).groupBy("is_query").count().collect()
        assert {r["is_query"]: r["count"] for r in rows} == {False: 20_000, True: 5 * min(slots, 20)}
    many = p.withColumnRenamed("pk", "qk").withColumn("qk", F.col("qk").cast("string"))
    few = q.withColumn("pk", F.length("qk").cast("long")).drop("qk")
    rows = deal(many, few, 64, 65_536, 131_072).groupBy("is_query").count().collect()
    assert {r["is_query"]: r["count"] for r in rows} == {True: 20_000, False: 5 * 64}


def _catalog(spark):
    rows = [
        (1, "red anvil", "Tools", "Group 1"),
        (2, "blue bolt", "Tools", "Group 2"),
        (3, "green cup", "Kitchen", "Group 3"),
        (4, "tin cup", "promo set", "Group 4"),
        (5, "gold ring", "Jewel", "Group 5"),
    ]
    return spark.createDataFrame(rows, "product_id long, product_text string, ProductType string, Level4_ProductGroup string")


def test_partly_blocked(spark):
    c = with_block_flags(_catalog(spark), ["anvil", "bolt"], ["promo", "group 5"])
    assert sorted(r["product_id"] for r in safe_catalog(c).collect()) == [3]


def test_all_blocked_falls_back(spark):
    c = with_block_flags(_catalog(spark), ["a", "e", "i", "o", "u"], [])
    assert safe_catalog(c).count() == 5


def test_safe_topk_two_allowed(spark):
    c = with_block_flags(_catalog(spark), ["anvil", "bolt", "gold"], [])
    allowed = safe_catalog(c).withColumn("p_emb", F.array(F.lit(1.0), F.lit(0.0))).withColumn("p_sq", F.lit(1.0))
    q = spark.createDataFrame([("q", [1.0, 0.0], 1.0)], "query string, q_emb array<float>, q_sq double")
    hits = catalog_topk(q, allowed, 5, "query", "product_id", normalized=False)
    assert hits.count() == 2
