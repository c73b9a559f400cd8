"""K2 over a ledger: every different request is asked once, and asking can be resumed.

A request is the prompt with the settings it is asked under; its key is their hash. The
ledger is a parquet folder of answered requests (``key, raw_text``) in shared storage.

Requests that it lacks are dealt to waves by their key, and each wave's answers are
appended to it before the next wave starts. So a job that dies, or is run again over more
prompts, asks what is missing only; what can be asked twice is one wave at most (what a
lost executor had asked of it). ``per_second`` bounds the requests of all tasks together.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.operators.judge import JudgeSettings
from shelfrank.session import default_parallelism, materialize, ship_package

LEDGER = "key string, raw_text string"
#: Requests of a wave: the most that are asked again after a failure.
WAVE_REQUESTS = 100_000


def request_key(prompt: Column, settings: JudgeSettings) -> Column:
    """SHA-256 of the settings and the prompt; parts are told apart by their lengths."""
    head = f"{len(settings.system_message)}:{settings.system_message}|{settings.temperature!r}|"
    return F.sha2(F.concat(F.lit(head), prompt), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Answered requests, one row a key (of two answers to one request the smaller text); none yet: empty."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return rows.groupBy("key").agg(F.min("raw_text").alias("raw_text"))


def _asking(judge_fn: Callable, settings: JudgeSettings, batch: int, pause: float) -> Callable:
    """Task function: ``batch`` requests a call, calls of a task at least ``pause`` seconds a request apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_at = 0.0
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                time.sleep(max(0.0, free_at - time.monotonic()))
                free_at = time.monotonic() + pause * len(part)
                answers = judge_fn(part["prompt"].tolist(), settings)
                if len(answers) != len(part):
                    raise ValueError(f"{len(part)} prompts, {len(answers)} answers")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "raw_text": ["" if a is None else a for a in answers]})

    return run


def ask_judge_once(
    prompts: DataFrame,
    judge_fn: Callable[[list[str], JudgeSettings], list[str]],
    ledger_path: str,
    prompt_col: str = "prompt",
    settings: JudgeSettings = JudgeSettings(),
    batch: int = 16,
    wave_requests: int = WAVE_REQUESTS,
    per_second: float | None = None,
) -> DataFrame:
    """``prompts`` with ``raw_text`` and ``reused`` (the answer was in the ledger before).

    Equal prompts are one request. A null prompt is not asked: its answer is null, not reused.
    ``judge_fn`` gets at most ``batch`` prompts a call; a null answer counts as empty.
    """
    if batch < 1 or wave_requests < 1 or (per_second is not None and per_second <= 0):
        raise ValueError("batch, wave_requests and per_second must be positive")
    spark = prompts.sparkSession
    ship_package(spark)
    had = materialize(read_ledger(spark, ledger_path))
    keyed = prompts.withColumn("_key", request_key(F.col(prompt_col), settings))
    wanted = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.min(prompt_col).alias("prompt"))
    missing = materialize(wanted.join(had.select("key"), "key", "left_anti"))
    n = missing.count()
    waves, slots = -(-n // wave_requests), default_parallelism(spark)
    run = _asking(judge_fn, settings, batch, 0.0 if per_second is None else slots / per_second)
    for wave in range(waves):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        asked = part.repartition(slots, "key").mapInPandas(run, LEDGER)
        asked.write.mode("append").parquet(ledger_path)
    answers = read_ledger(spark, ledger_path).select(F.col("key").alias("_key"), "raw_text")
    known = had.select(F.col("key").alias("_key"), F.lit(True).alias("_had"))
    out = keyed.join(answers.join(known, "_key", "left"), "_key", "left")
    return out.withColumn("reused", F.coalesce("_had", F.lit(False))).drop("_key", "_had")
