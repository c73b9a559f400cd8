"""Stored top-k lists that follow the catalog, held to a batch search over the live rows."""

import random

import pytest
from pyspark.sql import functions as F

from shelfrank.operators.encode import BatchEncoder, HashingEncoder
from shelfrank.streaming.maintained import EVENTS, MaintainedTopK

WORDS = ["bolt", "nut", "ring", "pipe", "saw", "nail", "hook", "rope"]


def _plain(queries, live, encoder, k):
    """Ranked (score, id) lists by the plain definition, from the encoder's own token buckets."""
    import hashlib
    import re
    from collections import Counter
    from math import sqrt

    def vec(text):
        toks = [t for t in re.split(r"[\W_]+", text.lower()) if t]
        return Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % encoder.dim for t in toks)

    def norm(v):
        return sqrt(sum(c * c for c in v.values()))

    out = {}
    for q in queries:
        a = vec("query: " + q)
        hits = []
        for pid, text in live.items():
            b = vec("passage: " + text)
            d = norm(a) * norm(b)
            hits.append((-(sum(c * b[x] for x, c in a.items()) / d if d else 0.0), pid))
        out[q] = [(p, round(-s, 9)) for s, p in sorted(hits)[:k]]
    return out


def _got(store, spark, n):
    out = {r["query"]: [] for r in store.lists(spark, n).collect()}
    for r in store.top(spark, n).orderBy("query", "rank").collect():
        out[r["query"]].append((r["product_id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("seed,compact,depth", [(2, 2, 4)])
def test_lists_equal_a_batch_search_after_every_batch(spark, tmp_out, seed, compact, depth):
    rnd, enc, k, ttl = random.Random(seed), HashingEncoder(64), 3, 1
    store = MaintainedTopK(f"{tmp_out}/state", enc, k, depth, ttl=ttl, compact_every=compact)
    live, seqs, asked = {}, {}, {}
    for n in range(4):
        events = [(None, None, 5, False, "no product"), ("  ", None, None, None, None)]
        for q in rnd.sample(WORDS, 3):
            events += [(f" {q} ", None, None, None, None)] * 2
            asked[q] = n
        newest = {}
        for _ in range(14 if n != 2 else 0):
            pid, seq = rnd.randrange(12), rnd.randrange(n * 8, n * 8 + 12)
            gone, text = rnd.random() < 0.4, " ".join(rnd.choices(WORDS, k=rnd.randrange(4))) or None
            events.append((None, pid, seq, gone, text))
            newest[pid] = max(newest.get(pid, (-1,)), (seq, gone, text or ""))
        for pid, (seq, gone, text) in newest.items():
            if seq > seqs.get(pid, -1):
                seqs[pid] = seq
                live.pop(pid, None)
                if not gone:
                    live[pid] = text
        batch = spark.createDataFrame(events, EVENTS).repartition(3)
        store.apply(batch, n)
        if n == 1:  # a replay, and rows that come again, change nothing
            store.apply(batch, n)
        assert _got(store, spark, n) == _plain([q for q, a in asked.items() if a >= n - ttl], live, enc, k), n


def test_only_short_lists_are_searched_again(spark, tmp_out, monkeypatch):
    enc = HashingEncoder(64)
    store = MaintainedTopK(f"{tmp_out}/state", enc, 2, 4, compact_every=8)
    texts = [(None, i, 1, False, f"bolt {'nut ' * i}") for i in range(10)]
    store.apply(spark.createDataFrame([("bolt", None, None, None, None), ("rope", None, None, None, None), *texts], EVENTS), 0)
    again = []
    refilled = MaintainedTopK._refilled
    monkeypatch.setattr(MaintainedTopK, "_refilled", lambda s, q, n: again.append(sorted(r["query"] for r in q.collect())) or refilled(s, q, n))
    store.apply(spark.createDataFrame([(None, 0, 2, True, None), (None, 1, 2, True, None)], EVENTS), 1)
    store.apply(spark.createDataFrame([(None, 2, 2, True, None), (None, 20, 2, False, "rope rope")], EVENTS), 2)
    assert again[0] == [] and "bolt" in again[1]
    live = {i: f"bolt {'nut ' * i}" for i in range(3, 10)} | {20: "rope rope"}
    assert _got(store, spark, 2) == _plain(["bolt", "rope"], live, enc, 2)


def test_empty_batches_and_a_batch_encoder(spark, tmp_out):
    enc = BatchEncoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2, model_id="length")
    store = MaintainedTopK(f"{tmp_out}/state", enc, 2, 2)
    store.apply(spark.createDataFrame([], EVENTS), 0)
    assert _got(store, spark, 0) == {}
    store.apply(spark.createDataFrame([("a", None, None, None, None)], EVENTS), 1)
    assert _got(store, spark, 1) == {"a": []}
    store.apply(spark.createDataFrame([(None, 1, 1, None, None), (None, 2, 1, False, "long text"), (None, 3, None, None, "x")], EVENTS), 2)
    assert [p for p, _ in _got(store, spark, 2)["a"]] == [2, 3]
    assert store.catalog(spark, 2).where(F.col("p_emb").isNull()).count() == 0


def test_settings_are_checked(tmp_out):
    with pytest.raises(ValueError):
        MaintainedTopK(tmp_out, HashingEncoder(64), 5, 4)
