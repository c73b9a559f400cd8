"""Registered queries of the operators (``opN_<name>``) and of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_bytes(name: str) -> bytes:
    """A tokenizer file, read on the driver (each is under 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@_register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.token_counts import count_tokens

    counted = count_tokens(_table(spark, sf_dir, "documents"), tokenizer_bytes("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@_register("op7_warc")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.warc import read_warc, warc_path, write_warc

    path = warc_path(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok")


@_register("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register("op9_feistel_shards")
def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.sharding import shard_rows

    placed = shard_rows(_table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_register("op10_source_mix")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.mixing import mix_copies

    return mix_copies(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


@_register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from shelfrank.llm.byte_bpe import decode, encode

    ranks = tokenizer_bytes("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(_table(spark, sf_dir, "documents"), ranks, PATTERN), ranks)
    return bpe_digest(coded)


def bpe_digest(coded: DataFrame, *extra: str) -> DataFrame:
    """Digest columns of encoded and decoded rows."""
    return coded.select(
        "doc_id", *extra, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_register("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


@_register("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.html_extract import extract_text

    texts = extract_text(_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_register("op4_multi_index")
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.near_vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


@_register("op5_masked_lm")
def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.masked_lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


@_register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.spelling import group_variants

    return group_variants(_table(spark, sf_dir, "documents"))


@_register("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register("op13_importance")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfrank.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
