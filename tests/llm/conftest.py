"""Small tables that hold nulls, empty and very long texts, ties, repeated rows and clashing names."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, n int, `key` string, m_x string, size string"
PARTS = "ba re to lin ver sta o mi ent ka der su al ti on".split()


def words(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def messy_texts():
    rng = random.Random(3)
    base = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)]
    texts = [None, "", "  \n\t ", "one two", "ONE two", "a b c d e", "A B C D E", "ça va l’été — 日本語 テスト 😀😀", "it's we'll   12345 !!! <s> ▁x  y "]
    texts += base + base[:7]
    for t in base[:25]:  # near-copies: some words changed at either end
        w = t.split()
        texts.append(" ".join(w[: max(1, len(w) - rng.randint(1, 3))] + words(rng, 1)).upper())
    texts += [" ".join(words(rng, 9000)), "x" * 5000, " " * 700 + "y", "é" * 400, "ab " * 3000, "line one is here\n" * 12 + "other line"]
    return texts


def docs_rows():
    texts = messy_texts()
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t or ""), i, 1, "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, "null id text of five words", "en", "s0", 0, 0, 0, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(docs_rows(), DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
