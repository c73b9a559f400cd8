"""The request ledger: each request is asked once, also across failures."""

import os

import pytest

from shelfrank.operators.judge import JudgeSettings
from shelfrank.operators.judge_ledger import ask_judge_once, read_ledger


def _counting(folder, fail_flag=None, bad=None):
    """A judge that notes every prompt in a file of its own; fails once on ``bad`` while the flag file is there."""
    import uuid

    def judge(prompts, settings):
        if fail_flag and bad in prompts and os.path.exists(fail_flag):
            os.remove(fail_flag)
            raise RuntimeError("the judge went away")
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
        return [f"{settings.temperature}:{p}" for p in prompts]

    return judge


def _asked(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


def _rows(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")


def test_asked_once_and_resumed_after_a_failure(spark, tmp_path):
    calls, flag, ledger = tmp_path / "calls", tmp_path / "flag", str(tmp_path / "ledger")
    calls.mkdir()
    flag.touch()
    prompts = [f"p{i % 20}" for i in range(60)] + [None, ""]
    judge = _counting(str(calls), str(flag), "p7")
    with pytest.raises(Exception, match="went away"):
        ask_judge_once(_rows(spark, prompts), judge, ledger, batch=2, wave_requests=4)
    done = {r["raw_text"] for r in read_ledger(spark, ledger).collect()}
    before = _asked(calls)
    got = ask_judge_once(_rows(spark, prompts), judge, ledger, batch=2, wave_requests=4).collect()
    assert {r["id"]: r["raw_text"] for r in got} == {i: None if p is None else f"0.0:{p}" for i, p in enumerate(prompts)}
    assert all(r["reused"] == (r["raw_text"] in done) for r in got)
    again = [p for p in set(before) if _asked(calls).count(p) > 1]
    assert all(f"0.0:{p}" not in done for p in again)  # nothing in the ledger was asked again
    total = len(_asked(calls))
    ask_judge_once(_rows(spark, prompts), judge, ledger)
    assert len(_asked(calls)) == total


def test_settings_are_part_of_the_request(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    for t in (0.0, 0.5, 0.0):
        got = ask_judge_once(_rows(spark, ["a"]), _counting(str(calls)), ledger, settings=JudgeSettings(temperature=t)).collect()
        assert got[0]["raw_text"] == f"{t}:a"
    assert _asked(calls) == ["a", "a"]


def test_empty_input_and_wrong_answers(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert ask_judge_once(_rows(spark, []), lambda p, s: [], ledger).count() == 0
    with pytest.raises(Exception, match="1 prompts, 0 answers"):
        ask_judge_once(_rows(spark, ["a"]), lambda p, s: [], ledger)
    with pytest.raises(ValueError):
        ask_judge_once(_rows(spark, ["a"]), lambda p, s: p, ledger, batch=0)


def test_rate_is_held(spark, tmp_path):
    import time

    t0 = time.monotonic()
    ask_judge_once(_rows(spark, [f"q{i}" for i in range(64)]), lambda p, s: p, str(tmp_path / "l"), batch=1, per_second=16)
    assert time.monotonic() - t0 > 3  # 64 requests, 16 a second, the first of each task at once
