"""Pairwise judging of two models' result lists.

The judge itself is pluggable: a user ``list[str] -> list[str]`` function run
batch-wise with ``mapInPandas`` (no client is built here), or a table of
responses joined on the pair key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.text import UNKNOWN_WINNER, judge_slug, slug, strip_code_fences
from shelfrank.schema import JUDGE_SCORES, VERDICT

# --- fixed values -------------------------------------------------------------------
NO_QUERY_TEXT = "UNKNOWN (no explicit query provided)."
JUDGE_SYSTEM_MESSAGE = "You are a strict JSON-only judge."
JUDGE_TEMPERATURE = 0.0
# -------------------------------------------------------------------------------------

# Our own prompt wording; it carries the query, both labels and both lists and
# asks for the verdict schema of :data:`shelfrank.schema.VERDICT`.
PROMPT_TEMPLATE = (
    "You compare two ranked lists of e-commerce search results for one shopper query.\n"
    "\n"
    "Query:\n"
    '"""{query}"""\n'
    "\n"
    "=== List from {label_a} ===\n"
    "{text_a}\n"
    "\n"
    "=== List from {label_b} ===\n"
    "{text_b}\n"
    "\n"
    "Give each list a whole number from 0 (worst) to 10 (best) for each of these four:\n"
    "relevance, diversity, usefulness, safety.\n"
    "\n"
    "Reply with JSON only, shaped exactly like this:\n"
    '{{"query": "...", "model_a_label": "{label_a}", "model_b_label": "{label_b}",\n'
    ' "scores": {{"model_a": {{"relevance": 0, "diversity": 0, "usefulness": 0, "safety": 0}},\n'
    '            "model_b": {{"relevance": 0, "diversity": 0, "usefulness": 0, "safety": 0}}}},\n'
    ' "overall_better": "model_a | model_b | tie",\n'
    ' "explanation": "one or two sentences"}}\n'
)

PROMPT_FIELDS = ("query", "label_a", "text_a", "label_b", "text_b")


def template_pieces(template: str = PROMPT_TEMPLATE) -> list[tuple[str, str | None]]:
    """Split the template into (literal, field-or-None) pieces, braces unescaped."""
    import string

    out = []
    for lit, field, _, _ in string.Formatter().parse(template):
        out.append((lit, field))
    return out


def build_prompt(
    query: Column, label_a: Column, text_a: Column, label_b: Column, text_b: Column, template: str = PROMPT_TEMPLATE
) -> Column:
    """K1: the prompt as one ``concat`` of literals and columns."""
    q = F.coalesce(query, F.lit(NO_QUERY_TEXT))
    cols = {"query": q, "label_a": label_a, "text_a": text_a, "label_b": label_b, "text_b": text_b}
    parts: list[Column] = []
    for lit, field in template_pieces(template):
        if lit:
            parts.append(F.lit(lit))
        if field:
            parts.append(cols[field])
    return F.concat(*parts)


def pair_reports(reports: DataFrame, query: str = "query", model: str = "model", report: str = "report") -> DataFrame:
    """Pair two models' reports of the same query (model_a < model_b)."""
    a = reports.select(F.col(query), F.col(model).alias("model_a"), F.col(report).alias("text_a"))
    b = reports.select(F.col(query), F.col(model).alias("model_b"), F.col(report).alias("text_b"))
    return a.join(b, query).where(F.col("model_a") < F.col("model_b"))


def judge_prompts(pairs: DataFrame, query: str = "query") -> DataFrame:
    """K1 over paired reports: ``query, model_a, model_b, prompt``."""
    return pairs.select(
        query,
        "model_a",
        "model_b",
        build_prompt(F.col(query), F.col("model_a"), F.col("text_a"), F.col("model_b"), F.col("text_b")).alias("prompt"),
    )


@dataclass(frozen=True)
class JudgeSettings:
    """What a judge is asked with, besides the prompt."""

    system_message: str = JUDGE_SYSTEM_MESSAGE
    temperature: float = JUDGE_TEMPERATURE


def ask_judge(
    prompts: DataFrame, judge_fn: Callable[[list[str], JudgeSettings], list[str]], prompt_col: str = "prompt", settings: JudgeSettings = JudgeSettings()
) -> DataFrame:
    """K2: run a user judge batch-wise (``mapInPandas``) on the prompts and the settings; adds ``raw_text``."""
    from shelfrank.session import ship_package

    ship_package(prompts.sparkSession)
    schema = T.StructType(prompts.schema.fields + [T.StructField("raw_text", T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            answers = judge_fn(pdf[prompt_col].tolist(), settings) if len(pdf) else []
            out = pdf.copy()
            out["raw_text"] = pd.Series([a if a is not None else "" for a in answers], index=pdf.index, dtype=object)
            yield out

    return prompts.mapInPandas(run, schema)


def _as_text(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), True) for f in t.fields])
    return T.StringType()


#: The verdict with every leaf as text, so that quoted numbers are not lost.
AS_TEXT = _as_text(VERDICT)


def _scores(s: Column) -> Column:
    """A model's scores in their own types."""
    return F.when(s.isNotNull(), F.struct(*[s[f.name].try_cast(f.dataType).alias(f.name) for f in JUDGE_SCORES.fields]))


def one_json_value(text: Column) -> Column:
    """Whether all of ``text`` is one JSON value. The parser stops behind the
    first value, so the text is put where anything left over makes it fail: as
    the only item of an array, and as the value of a key."""
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    value = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.variant_get(item, "$[0]", "variant").isNotNull() & F.variant_get(item, "$[1]", "variant").isNull()
    return F.coalesce(one & value.isNotNull(), F.lit(False))


def parse_verdicts(responses: DataFrame, raw: str = "raw_text") -> DataFrame:
    """K3 + K4 + K5: strip fences, parse, extract scores and the winner.

    ``parsed_ok`` is whether the whole stripped text is one JSON value
    (``from_json`` cannot tell: bad input gives a struct of nulls, and text after
    the value is not looked at). Scores may be numbers or strings of numbers;
    other strings give null. Duplicate keys and the non-standard ``NaN`` and
    ``Infinity`` count as not parsed. Unparsed rows keep the raw text as
    ``payload`` and get no winner; parsed rows without one get ``unknown``.
    """
    cleaned = strip_code_fences(F.col(raw))
    d = responses.withColumn("cleaned", cleaned).withColumn(
        "parsed_ok", one_json_value(F.col("cleaned"))
    )
    v = F.from_json(F.col("cleaned"), AS_TEXT)
    d = d.withColumn("_v", F.when(F.col("parsed_ok"), v))
    return d.select(
        *[c for c in responses.columns],
        "cleaned",
        "parsed_ok",
        F.when(F.col("parsed_ok"), F.col("cleaned")).otherwise(F.col(raw)).alias("payload"),
        _scores(F.col("_v.scores.model_a")).alias("scores_a"),
        _scores(F.col("_v.scores.model_b")).alias("scores_b"),
        F.when(F.col("parsed_ok"), F.coalesce(F.col("_v.overall_better"), F.lit(UNKNOWN_WINNER))).alias("overall_better"),
    )


def judgement_file_name(query: Column, stem_a: Column, stem_b: Column) -> Column:
    """K6: ``judge_<slug40>__<a>__vs__<b>.json``."""
    return F.concat(F.lit("judge_"), judge_slug(query), F.lit("__"), stem_a, F.lit("__vs__"), stem_b, F.lit(".json"))


def report_file_stem(query: Column) -> Column:
    """Stem of a per-query result file: the query slug (default ``query``)."""
    return slug(query)


def stub_judge(answer: str) -> Callable[[list[str], JudgeSettings], list[Any]]:
    """A local stand-in judge (tests): returns the same answer for every prompt."""
    return lambda prompts, settings: [answer] * len(prompts)
