"""Operator 8: quality rules with risk-controlled thresholds.

Fixed base rules reject broken texts. Beyond them a logistic model, fitted on a
bounded sample of labelled rows, scores how likely a text is bad; the cutoff of
each stratum comes from the labelled rows that the model did not see. Cutoffs
are tested from the most lenient to stricter ones with an exact binomial test
of "more than ``max_false`` of the good texts are rejected"; the last one before
the first test that is not passed is taken (a fixed sequence needs no correction
inside a stratum), and the error level is divided by the number of strata that
have good rows enough to pass any test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import mix64, python_ready, written

#: Rows that the logistic model is fitted on, at most.
MAX_TRAIN_ROWS = 20_000
#: Share of good texts that may be rejected, and the chance that the bound fails.
MAX_FALSE, ERROR = 0.02, 0.05
#: Scores are cut into so many steps; every one is a cutoff that may be tried.
STEPS = 1000

_WHITE = b" \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_INPUTS = ("symbols", "dup_lines", "repeats", "word_length", "digits", "capitals", "size", "other_marks")

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = BASE + ", " + ", ".join(f"f_{x} double" for x in _INPUTS)


def _repeat_words(codes: np.ndarray) -> int:
    """Words that lie in a 5-word window which occurs twice or more."""
    k = len(codes) - 4
    if k < 2:
        return 0
    h = codes[:k].copy()
    for j in range(1, 5):
        h = mix64(h) + codes[j : j + k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(k, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class _Measure:
    """Measures texts; remembers the codes of words it has seen (emptied when full: 64 MB at most)."""

    LIMIT, LONGEST = 100_000, 256

    def __init__(self):
        self.codes: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple:
        import xxhash

        if not text:
            return (0,) * 5 + (0.0,) * len(_INPUTS)
        data = text.encode()
        words = data.split()  # the six ASCII white space characters
        n = len(words)
        n_chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        n_symbols = sum(map(text.count, _SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip(_WHITE)]
        n_dup = len(lines) - len(set(lines))
        codes = self.codes
        if len(codes) > self.LIMIT:
            codes.clear()
        fresh = {w: xxhash.xxh3_64_intdigest(w) for w in set(words).difference(codes)}
        n_repeat = _repeat_words(np.fromiter((codes[w] if w in codes else fresh[w] for w in words) if fresh else map(codes.__getitem__, words), np.uint64, n))
        codes.update((w, c) for w, c in fresh.items() if len(w) <= self.LONGEST)
        raw = np.frombuffer(data, np.uint8)
        count = np.bincount(raw, minlength=256)
        d = max(1, n)
        marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) - n_symbols
        return (
            n, n_chars, n_symbols, n_dup, n_repeat,
            min(2.0, n_symbols / d), n_dup / max(1, len(lines)), n_repeat / d, min(30.0, n_chars / d) / 10,
            int(count[48:58].sum()) / max(1, n_chars), int(count[65:91].sum()) / max(1, n_chars), math.log1p(n) / 5, marks / max(1, n_chars),
        )


def measures(text: Column) -> Column:
    """The base counts and model inputs of a text as one struct column."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        measure = _Measure()
        for part in parts:
            yield pd.DataFrame([measure(t) for t in part], columns=names)

    return measured(text)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton steps on the ridge-penalised likelihood."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return np.round(w, 9)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the beta integral."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 10_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + top / c
                c = c if abs(c) > tiny else tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def choose_cutoff(counts: np.ndarray, max_false: float, level: float, lowest: int = 0) -> int:
    """The strictest cutoff (reject steps at or above it) whose tests all pass.

    ``counts[s]`` good held-out rows have step ``s``; ``len(counts)`` rejects nothing."""
    n = int(counts.sum())
    best, rejected = len(counts), 0
    for cut in range(len(counts) - 1, lowest - 1, -1):
        new = rejected + int(counts[cut])
        if (cut == len(counts) - 1 or new != rejected) and binomial_tail(new, n, max_false) > level:
            break
        best, rejected = cut, new
    return best


def with_power(strata: list, good, max_false: float, error: float) -> list:
    """Strata that could pass a test at all, with the error level shared among just these.

    The choice looks at the numbers of good rows only, not at what is rejected, so the level holds.
    """
    left = strata
    while True:
        able = [r for r in left if binomial_tail(0, good(r), max_false) <= error / len(left)]
        if len(able) == len(left):
            return able
        left = able


class Verdict:
    """The fitted model and the cutoffs of the strata."""

    def __init__(self, weights: np.ndarray, cutoffs: dict[str | None, int]):
        self.weights, self.cutoffs = weights, cutoffs

    def step(self) -> Column:
        z = F.lit(float(self.weights[0]))
        for name, w in zip(_INPUTS, self.weights[1:], strict=True):
            z = z + F.col(f"f_{name}") * F.lit(float(w))
        return F.least(F.floor(F.lit(float(STEPS)) / (1 + F.exp(-z))), F.lit(STEPS - 1)).cast("int")

    def cutoff(self, stratum: Column) -> Column:
        named = {k: v for k, v in self.cutoffs.items() if k is not None}
        known = F.lit(None).cast("int")
        if named:
            known = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[stratum]
        if None in self.cutoffs:
            known = F.when(stratum.isNull(), F.lit(self.cutoffs[None])).otherwise(known)
        return F.coalesce(known, F.lit(STEPS))

    def kept(self, stratum: Column) -> Column:
        return ~base_failed() & (self.step() < self.cutoff(stratum))


def fit_verdict(
    measured: DataFrame, labels: DataFrame, *, max_false: float = MAX_FALSE, error: float = ERROR, max_train: int = MAX_TRAIN_ROWS, seed: int = 8
) -> Verdict:
    """Fit on one half of the labelled rows (a bounded hash sample of it), choose
    cutoffs on all of the other half. ``measured``: ``q_key, q_stratum`` and the
    measures of every row; ``labels``: ``doc_id, quality``. Conflicting labels of
    an id count as bad; null labels and ids are not used."""
    known = labels.select(F.col("doc_id").alias("l_key"), F.col("quality").alias("l_good")).where("l_key is not null and l_good is not null")
    known = known.groupBy("l_key").agg(F.min("l_good").alias("l_good"))
    rows = measured.join(known, measured["q_key"] == known["l_key"]).drop("q_key")
    rows = written(rows.where(~base_failed()).withColumn("l_half", F.pmod(F.xxhash64("l_key", F.lit(seed)), F.lit(2))).withColumn("l_place", F.shiftrightunsigned(F.xxhash64("l_key", F.lit(seed + 1)), 33)), "quality-labelled")
    n_train = rows.where("l_half = 0").count()
    share = min(1.0, max_train / max(1, n_train)) * 0.97 if n_train > max_train else 1.0
    train = rows.where((F.col("l_half") == 0) & (F.col("l_place") < int(share * (1 << 31))))
    sample = train.orderBy("l_place", "l_key").select("l_good", *[f"f_{x}" for x in _INPUTS]).limit(max_train).toPandas()
    bad = (sample["l_good"] == 0).to_numpy(float)
    if len(sample) == 0 or bad.min() == bad.max():
        return Verdict(np.zeros(len(_INPUTS) + 1), {})
    verdict = Verdict(fit_logistic(sample[[f"f_{x}" for x in _INPUTS]].to_numpy(float), bad), {})
    held = rows.where("l_half = 1 and l_good <> 0").groupBy("q_stratum", verdict.step().alias("step")).agg(F.count("*").alias("n"))
    per = held.groupBy("q_stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("step", "n")).alias("steps"))
    tested = with_power(per.collect(), lambda r: r["n"], max_false, error)  # at most STEPS numbers a stratum
    for r in tested:
        counts = np.zeros(STEPS, np.int64)
        for s in r["steps"]:
            counts[s["step"]] += s["n"]
        verdict.cutoffs[r["q_stratum"]] = choose_cutoff(counts, max_false, error / len(tested))
    return verdict


def _measured_rows(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    slim = python_ready(docs.select(F.col(key).alias("q_key"), F.col(stratum).alias("q_stratum"), F.col(text).alias("q_text")))
    return slim.select("q_key", "q_stratum", measures(F.col("q_text")).alias("q")).select("q_key", "q_stratum", "q.*")


def quality_rules(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", **params) -> DataFrame:
    """Base counts, score step, cutoff and verdict of every row.

    Null and empty texts have no words and fail; a stratum with too few labelled
    rows (or no labels at all) rejects nothing beyond the base rules; a null
    stratum is a stratum of its own; an empty table gives an empty result. Extra
    columns are not read.
    """
    measured = written(_measured_rows(docs, key, text, stratum), "quality-measures")
    v = fit_verdict(measured, labels, **params)
    return measured.select(
        F.col("q_key").alias(key), F.col("q_stratum").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), v.step().alias("step"), v.cutoff(F.col("q_stratum")).alias("cutoff"), v.kept(F.col("q_stratum")).alias("kept"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, in place (no
    shuffle of texts): texts are measured once and written with their measures;
    the fit reads the measures, then rows are filtered. Nulls, empty texts and
    tables as in :func:`quality_rules`; repeated rows are judged alike."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    rows = python_ready(docs).select(F.struct(*[docs[c] for c in docs.columns]).alias("q__row"), docs[key].alias("q_key"), docs[stratum].alias("q_stratum"), measures(docs[text]).alias("q__m"))
    rows = written(rows.select("q__row", "q_key", "q_stratum", *[F.col(f"q__m.{x}").alias(x) for x in names]), "quality-measured")
    v = fit_verdict(rows.drop("q__row"), labels, **params)
    return rows.where(v.kept(F.col("q_stratum"))).select("q__row.*")
