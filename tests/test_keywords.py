"""Long keyword lists: the automaton finds what one predicate a keyword finds."""

import random

from pyspark.sql import functions as F

from shelfrank.functions import keywords as K
from shelfrank.functions.text import any_literal, any_regex

ALPHABET = "abcé ☃𝄞"


def _texts(spark, n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(i, "".join(rnd.choices(ALPHABET, k=rnd.randrange(9))).upper()) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "abc " * 50_000 + "☃☃☃☃")]
    return spark.createDataFrame(rows, "id long, t string"), {i: (t or "").lower() for i, t in rows}


def _keywords(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randrange(2, 6))) for _ in range(n)] + ["☃☃☃☃"]


def test_automaton_equals_substrings(spark):
    df, texts = _texts(spark)
    kws = _keywords(400)
    got = df.select("id", any_literal(["t"], kws).alias("hit"), K.contained(F.lower("t"), kws).alias("found")).collect()
    assert {r["id"]: (r["hit"], r["found"]) for r in got} == {
        i: (any(k in t for k in kws), sorted({k for k in kws if k in t})) for i, t in texts.items()
    }


def test_parts_lose_no_keyword(spark, monkeypatch):
    monkeypatch.setattr(K, "AUTOMATON_CHARS", 100)
    kws = _keywords(90) + ["a" * 300]
    parts = K.keyword_parts(kws)
    assert len(parts) > 3 and sorted(k for p in parts for k in p) == sorted(set(kws))
    assert all(len(p) == 1 or sum(map(len, p)) <= 100 for p in parts)
    df, texts = _texts(spark, 60)
    got = {r["id"]: r["f"] for r in df.select("id", K.contained(F.lower("t"), kws).alias("f")).collect()}
    assert got == {i: sorted({k for k in kws if k in t}) for i, t in texts.items()}


def test_empty_and_mixed_lists(spark):
    df, texts = _texts(spark, 60)
    many = _keywords(60)
    got = df.select(
        "id",
        any_literal(["t"], [*many, ""]).alias("all"),
        K.contained(F.lower("t"), []).alias("none"),
        any_regex("t", [*many, "a.c", "^b"]).alias("regex"),
    ).collect()
    assert all(r["all"] and r["none"] == [] for r in got)
    import re

    assert {r["id"]: r["regex"] for r in got} == {
        i: any(k in t for k in many) or bool(re.search("a.c|^b", t)) for i, t in texts.items()
    }


def test_plan_does_not_grow_with_the_list(spark):
    df, _ = _texts(spark, 5)
    plans = [df.select(any_literal(["t"], _keywords(n)).alias("h"))._jdf.queryExecution().optimizedPlan().toString() for n in (100, 10_000)]
    assert plans[0].count("any_hit") == plans[1].count("any_hit") >= 1
