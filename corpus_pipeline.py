"""The corpus pipeline: quality rules, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm.byte_bpe import decode, encode
from shelfrank.llm.common import written
from shelfrank.llm.jaccard_join import keep_one
from shelfrank.llm.mixing import apply_mix
from shelfrank.llm.quality import keep_quality
from shelfrank.llm.queries import bpe_digest, tokenizer_bytes


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules reject go."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-copies stays."""
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as the mix takes it."""
    return apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: digests of the token ids of every row of the mix, and of what they decode to."""
    from public_tokenizers import PATTERN

    ranks = tokenizer_bytes("byte_bpe_multi_50k.tiktoken")
    return bpe_digest(decode(encode(docs, ranks, PATTERN), ranks))


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", join_stage), ("mixing", mixing_stage), ("byte-level BPE", bpe_stage)]

#: The model's verdict and the id lists have no SQL form; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
