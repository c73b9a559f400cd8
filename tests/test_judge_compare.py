"""Judging (prompts, stub judge, parsing) and the leaderboard."""

import pytest
from pyspark.sql import functions as F

from shelfrank.operators.compare import leaderboard
from shelfrank.operators.judge import ask_judge, build_prompt, judgement_file_name, parse_verdicts, stub_judge
from shelfrank.schema import EXPERIMENTS, MODEL_ATTRIBUTES


def test_prompt_and_stub_judge(spark):
    df = spark.createDataFrame([("black dress", "a", "list A", "b", "list B"), (None, "a", "x", "b", "y")], "query string, la string, ta string, lb string, tb string")
    p = df.select(build_prompt(*[F.col(c) for c in df.columns]).alias("prompt"))
    texts = [r[0] for r in p.collect()]
    assert "black dress" in texts[0] and "list A" in texts[0] and "list B" in texts[0]
    assert "UNKNOWN (no explicit query provided)." in texts[1]
    answer = '```json\n{"scores":{"model_a":{"relevance":7},"model_b":{"relevance":3}},"overall_better":"model_a"}\n```'
    judged = parse_verdicts(ask_judge(p, stub_judge(answer))).collect()
    assert all(r["parsed_ok"] and r["overall_better"] == "model_a" and r["scores_a"]["relevance"] == 7.0 for r in judged)


def test_parse_failures_keep_raw(spark):
    df = spark.createDataFrame([("I prefer model B",), ('{"scores":{}}',)], "raw_text string")
    r = parse_verdicts(df).collect()
    assert r[0]["parsed_ok"] is False and r[0]["payload"] == "I prefer model B" and r[0]["overall_better"] is None
    assert r[1]["parsed_ok"] is True and r[1]["overall_better"] == "unknown"


def test_judgement_file_name(spark):
    df = spark.createDataFrame([("black dress", "blackdress", "blackdress")], "q string, a string, b string")
    name = df.select(judgement_file_name(F.col("q"), F.col("a"), F.col("b"))).collect()[0][0]
    assert name == "judge_blackdress__blackdress__vs__blackdress.json"


def _metrics(spark, rows):
    return spark.createDataFrame(
        rows,
        "exp_name string, `hit@1` double, `hit@5` double, `hit@10` double, `mrr@10` double, `ndcg@10` double, "
        "num_queries long, total_time_sec double, total_texts_embedded long",
    )


def test_leaderboard_throughput_guards(spark):
    exps = spark.createDataFrame(
        [("e1", "hf", "m1", None, "a"), ("e2", "api", "m2", "openai", "b"), ("e3", "hf", "m3", None, "c")], EXPERIMENTS
    )
    mets = _metrics(
        spark,
        [
            ("e1", 0.1, 0.2, 0.3, 0.4, 0.5, 10, 0.0, None),  # time 0 -> null speed
            ("e2", 0.1, 0.2, 0.3, 0.4, 0.5, 10, 5.0, 100),  # api with texts
            ("e3", 0.1, 0.2, 0.3, 0.4, 0.5, None, None, None),  # bi-encoder variant
        ],
    )
    attrs = spark.createDataFrame([("m1", 278.0, 768, 12), ("m2", 1.0, 1, 1)], MODEL_ATTRIBUTES)
    lb = {r["exp_name"]: r for r in leaderboard(exps, mets, attrs).collect()}
    assert lb["e1"]["queries_per_sec"] is None and lb["e1"]["provider"] == "local"
    assert lb["e2"]["queries_per_sec"] == pytest.approx(2.0) and lb["e2"]["queries_per_min"] == pytest.approx(120.0)
    assert lb["e2"]["texts_per_sec"] == pytest.approx(20.0) and lb["e2"]["provider"] == "openai"
    assert lb["e2"]["params_millions"] is None  # attributes only for hf
    assert lb["e1"]["embedding_dim"] == 768 and lb["e3"]["embedding_dim"] is None
    assert lb["e3"]["queries_per_sec"] is None


def test_leaderboard_missing_metrics_fails(spark):
    exps = spark.createDataFrame([("e1", "hf", "m1", None, "a"), ("missing", "hf", "m1", None, "b")], EXPERIMENTS)
    mets = _metrics(spark, [("e1", 0.1, 0.2, 0.3, 0.4, 0.5, 10, 1.0, None)])
    with pytest.raises(Exception, match="metrics not found for experiment missing"):
        leaderboard(exps, mets).collect()


def test_only_whole_json_documents_count_as_parsed(spark):
    from shelfrank.operators.judge import parse_verdicts

    texts = {
        '{"a":1}': True, '{"a":1} trailing': False, "1, 2": False, '{"a":1}] x': False, '1} x': False, "": False, "[]": True, '"x"': True, "null": True, "```json\n{}\n```": True,
        '{"scores":{"model_a":{"relevance":"7","safety":3},"model_b":{"relevance":"high"}}}': True,
    }
    rows = {r["raw_text"]: r for r in parse_verdicts(spark.createDataFrame([(t,) for t in texts], "raw_text string")).collect()}
    assert {t: r["parsed_ok"] for t, r in rows.items()} == texts
    r = rows['{"scores":{"model_a":{"relevance":"7","safety":3},"model_b":{"relevance":"high"}}}']
    assert (r["scores_a"]["relevance"], r["scores_a"]["safety"], r["scores_b"]["relevance"], r["overall_better"]) == (7, 3, None, "unknown")
    assert rows['{"a":1} trailing']["payload"] == '{"a":1} trailing'


def test_null_vectors_and_ties_in_a_block():
    import numpy as np

    from shelfrank.operators.slot_index import SlotIndex

    p = np.ones((50, 2))
    p[3] = np.nan
    index = SlotIndex(p, np.arange(50))
    _, rows, scores = index.top(np.ones((2, 2)), np.zeros(2), 50)
    assert rows[:50].tolist() == [i for i in range(50) if i != 3] + [3] and np.isnan(scores[49])
    _, cols, _ = index.top(np.ones((2, 2)), np.zeros(2), 4)
    assert cols.tolist() == [0, 1, 2, 4] * 2
