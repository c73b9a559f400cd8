"""Vector cache: snapshots, crashes, races, compaction."""

import pytest
from pyspark.sql import functions as F

from shelfrank.operators.encode import HashingEncoder, cached_encode
from shelfrank.operators.vector_cache import CommitConflict, VectorCache

ENC = HashingEncoder(8)


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "text string")


def vectors(df):
    return {r["text"]: list(r["embedding"]) for r in df.collect()}


def expected(spark, *rows):
    return vectors(ENC.encode(texts(spark, *rows), "text", "embedding"))


@pytest.fixture
def cache(spark, tmp_path):
    return VectorCache(spark, str(tmp_path), "m/1")


def test_appends_encode_only_what_is_missing(spark, cache):
    cache.append(texts(spark, "a b", "c", None, "a b"), ENC)
    [folder] = cache.append(texts(spark, "c", "d e"), ENC)
    assert [r["text"] for r in cache.read(folders=[folder]).collect()] == ["d e"]
    assert cache.append(texts(spark, "c", None), ENC) == []
    assert cache.version() == 2
    assert vectors(cache.read()) == expected(spark, "a b", "c", "d e")
    assert vectors(cache.lookup(texts(spark, "c", "unknown", None))) == expected(spark, "c")
    assert vectors(cache.read(version=1)) == expected(spark, "a b", "c")


def test_crash_between_write_and_commit_leaves_no_trace_in_reads(spark, cache, monkeypatch):
    cache.append(texts(spark, "a"), ENC)
    with monkeypatch.context() as m:
        m.setattr(VectorCache, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            cache.append(texts(spark, "a", "b"), ENC)
    assert vectors(cache.read()) == expected(spark, "a")
    assert len(cache.unused()) == 1
    cache.append(texts(spark, "a", "b"), ENC)
    assert vectors(cache.read()) == expected(spark, "a", "b")
    assert cache.read().count() == 2


def test_a_writer_that_comes_second_looks_again(spark, cache, monkeypatch):
    other = VectorCache(spark, cache.root.rsplit("/", 1)[0], "m/1")
    commit, first = VectorCache._commit, [True]

    def raced(self, base, folders):
        if self is cache and first:
            first.clear()
            other.append(texts(spark, "a", "x"), ENC)  # between this writer's write and its commit
        return commit(self, base, folders)

    monkeypatch.setattr(VectorCache, "_commit", raced)
    cache.append(texts(spark, "a", "b"), ENC)
    assert cache.version() == 2
    assert sorted(r["text"] for r in cache.read().collect()) == ["a", "b", "x"]  # "a" once
    with pytest.raises(CommitConflict):
        cache._commit(1, [])


def test_compaction_keeps_rows_and_old_snapshots(spark, cache):
    for t in ("a", "b", "c"):
        cache.append(texts(spark, t), ENC)
    old = cache.folders()
    assert cache.compact() == 4 and len(cache.folders()) == 1
    assert vectors(cache.read()) == vectors(cache.read(folders=old)) == expected(spark, "a", "b", "c")
    assert cache.compact() == 4


def test_lookup_regroups_nothing(spark, cache):
    cache.append(texts(spark, "a", "b"), ENC)
    plan = cache.lookup(texts(spark, "a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the distinct texts that are asked for
    missing = cache.missing(texts(spark, "z"))._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in missing


def test_cached_encode_returns_all_requested(spark, tmp_path):
    got = cached_encode(spark, texts(spark, "a", "b").withColumn("bucket", F.lit(1)), ENC, str(tmp_path))
    assert vectors(got) == expected(spark, "a", "b")
