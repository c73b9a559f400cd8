"""Operator 3: byte-level BPE encoding and decoding with higher-order functions.

Texts are cut by the tokenizer's pattern. A word's merges are a fold: each step
merges the adjacent pair of lowest rank, found in a literal rank map that is
keyed by pairs of token ids. Distinct words are counted over all documents; the
most frequent ones, up to a fixed number, are folded once and form a dictionary
that every task holds; any other word is folded where it stands. Both give the
same ids, so the dictionary's size changes only the time. Decoding looks up each
id's bytes and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written

#: Words in the dictionary, at most, and the longest of them in bytes.
DICTIONARY_WORDS, DICTIONARY_BYTES = 1 << 18, 64
#: A fold's steps grow with the square of the word; longer words are merged with a heap.
FOLD_BYTES = 256
PAIR_BUCKETS, WORD_BUCKETS, VOCABULARY_BUCKETS = 1 << 16, 1 << 17, 1 << 14
_SHIFT_BITS = 21
_SHIFT = 1 << _SHIFT_BITS  # above any token id
_NO_PAIR = 1 << 24  # above any rank


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of tokens whose bytes together are a token, and that token."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merges of one long word with a heap: O(n log n), for what a fold can't hold."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, end = list(range(n)), list(range(1, n + 1))
    after, before, live = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n

    def pair(i):
        j = after[i]
        return None if j < 0 else ranks.get(word[start[i] : end[j]])

    heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j < 0 or end[j] != stop or pair(i) != r:
            continue
        end[i], after[i], live[j] = end[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if live[i]]


def _bucketed(spark: SparkSession, keys: pa.Array, values: pa.Array, buckets: np.ndarray, n: int) -> DataFrame:
    """One row, one column: an array of ``n`` small maps, a key in its bucket's map."""
    order = pa.array(np.argsort(buckets, kind="stable"))
    starts = np.concatenate([[0], np.cumsum(np.bincount(buckets, minlength=n))]).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(starts), keys.take(order), values.take(order))
    return spark.createDataFrame(pa.table({"t": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), maps)})).coalesce(1)


class Tables:
    """The tokenizer's lookup tables as one-row DataFrames (all of fixed size)."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        merges = merge_pairs(ranks)
        left, right = np.array(list(merges), np.int64).reshape(-1, 2).T
        self.pairs = _bucketed(spark, pa.array(left * _SHIFT + right), pa.array(list(merges.values()), pa.int32()), (left * 40503 + right) % PAIR_BUCKETS, PAIR_BUCKETS)
        tokens = pa.array(list(ranks), pa.binary())
        self.tokens = _bucketed(spark, tokens, pa.array(list(ranks.values()), pa.int32()), np.array([zlib.crc32(t) % VOCABULARY_BUCKETS for t in ranks]), VOCABULARY_BUCKETS)
        self.bytes = spark.createDataFrame(pa.table({"t": pa.array([[ranks[bytes([b])] for b in range(256)]], pa.list_(pa.int32()))})).coalesce(1)


def pieces_of(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: every id's bytes, as hexadecimal strings."""
    by_id = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        by_id[r] = t
    return spark.createDataFrame(pa.table({"t": pa.array([[t.hex() for t in by_id]], pa.list_(pa.string()))})).coalesce(1)


def _at(table: Column, i: Column) -> Column:
    return F.get(table, i.cast("int"))


def _pair_rank(pairs: Column, a: Column, b: Column) -> Column:
    bucket = F.pmod(a.cast("long") * 40503 + b, F.lit(PAIR_BUCKETS))
    return F.try_element_at(_at(pairs, bucket), a.cast("long") * _SHIFT + b)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(word: Column, t: Column) -> Column:
    """Token ids of a word (binary column) by folded merges; ``t``: struct of tables.

    The state is one array: each token's id, and above it the rank of the pair
    that it makes with the next token. A step merges the first pair of lowest
    rank and looks up the two pairs that it touches.
    """
    n = F.octet_length(word)
    latin = F.split(F.decode(word, "ISO-8859-1"), "")  # a character for each byte
    first = F.transform(latin, lambda c: _at(t["bytes"], F.ascii(c)))

    def packed(a, b):
        rank = F.coalesce(_pair_rank(t["pairs"], a, b).cast("long"), F.lit(_NO_PAIR))
        return rank * F.lit(_SHIFT) + a

    def step(state):
        def token(i):
            return F.get(state, i).bitwiseAND(_SHIFT - 1)

        def merge(m):
            def at(p):
                p = p.cast("int")
                joined = packed(m, token(p + 1))
                head = F.when(p > 1, F.concat(F.slice(state, F.lit(1), p - 2), F.array(packed(token(p - 2), m), joined))).otherwise(F.array(joined))
                return F.concat(head, F.slice(state, p + 2, F.size(state)))

            ranks = F.transform(state, lambda x: F.shiftright(x, _SHIFT_BITS))
            return F.when(m >= _NO_PAIR, state).otherwise(_let(F.array_position(ranks, m), at))

        return _let(F.shiftright(F.array_min(state), _SHIFT_BITS), merge)

    start = _let(first, lambda ids: F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: packed(a.cast("long"), b)))
    merged = F.aggregate(F.sequence(F.lit(2), n), start, lambda s, _: step(s), lambda s: F.transform(s, lambda x: x.bitwiseAND(_SHIFT - 1).cast("int")))
    whole = F.try_element_at(_at(t["tokens"], F.pmod(F.crc32(word), F.lit(VOCABULARY_BUCKETS))), word)
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.when(whole.isNotNull(), F.array(whole)).otherwise(merged))


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the tokenizer's pattern, with Unicode white space and classes."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def frequent_words(docs: DataFrame, text: str, pattern: str, limit: int) -> DataFrame:
    """Words with counts, the most frequent first by count: all words whose count is
    above the lowest count at which there are no more than ``limit`` of them."""
    words = docs.select(F.explode(F.array_distinct(words_of(F.col(text), pattern))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.octet_length("word") <= DICTIONARY_BYTES).where("n > 1"), "bpe-words")
    # counts in sixteenths of powers of two: a bounded histogram gives the lowest count
    step = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect(), key=lambda r: -r["s"]):
        total += r["k"]
        if total > limit:
            break
        least = r["low"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least)


def _with_tables(df: DataFrame, **tables: DataFrame) -> DataFrame:
    """Adds one-row tables as columns; used once each, so they stay out of the rows
    (the optimizer folds them into the expression that reads them)."""
    for name, t in tables.items():
        df = df.withColumn(f"b_{name}", t.scalar())
    return df


def _tables(*names: str) -> Column:
    return F.array(F.struct(*[F.col(f"b_{n}").alias(n) for n in names]))


def dictionary(docs: DataFrame, tables: Tables, *, text: str, pattern: str, limit: int) -> DataFrame:
    """One row: the frequent words' ids in hashed buckets. Tasks fold the words and
    one of them puts the row together, so the driver only passes it on."""
    words = frequent_words(docs, text, pattern, limit)
    bound = _with_tables(words, pairs=tables.pairs, tokens=tables.tokens, bytes=tables.bytes)
    ids = F.get(F.transform(_tables("pairs", "tokens", "bytes"), lambda t: fold_word(F.col("word").cast("binary"), t)), F.lit(0))
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(WORD_BUCKETS)).cast("int")
    folded = written(bound.select(bucket.alias("bucket"), F.struct("word", ids.alias("ids")).alias("entry")), "bpe-dictionary")
    none = docs.sparkSession.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast(folded.schema["entry"].dataType).alias("entry"))
    buckets = folded.unionAll(none).groupBy("bucket").agg(F.collect_list("entry").alias("entries"))  # without the nulls
    row = F.sort_array(F.collect_list(F.struct("bucket", "entries")))  # at most ``limit`` short words
    return buckets.agg(F.transform(row, lambda b: F.map_from_entries(b["entries"])).alias("t"))


def _long_words(ranks_bytes, pattern: str):
    """Arrow function: ids of the words of a text that are too long for a fold."""

    @F.pandas_udf("map<string, array<int>>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = None
        for part in parts:
            out = []
            for words in part:
                if words is None or not len(words):
                    out.append({})
                    continue
                ranks = ranks or parse_ranks(ranks_bytes.value)
                out.append({w: merge_word(w.encode(), ranks) for w in words})
            yield pd.Series(out)

    return encode


def encode(docs: DataFrame, rank_file: bytes, pattern: str, *, key: str = "doc_id", text: str = "text", dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """``key, ids`` for every row, in the order of the text; no shuffle of texts.

    Null and empty texts have no ids; repeated rows are encoded each; extra
    columns are not read; an empty table gives an empty result.
    """
    spark = python_ready(docs).sparkSession
    tables = Tables(spark, parse_ranks(rank_file))
    slim = docs.select(F.col(key).alias("b_key"), F.coalesce(F.col(text), F.lit("")).alias("b_text"))
    known = dictionary(slim, tables, text="b_text", pattern=pattern, limit=dictionary_words)
    # a word of over FOLD_BYTES bytes has a quarter as many characters in a row without ASCII white space, or of Unicode white space
    run = FOLD_BYTES // 4
    suspect = F.col("b_text").rlike(rf"(?<!\S)\S{{{run}}}|(?U:(?<!\s)\s{{{run}}})")
    long_words = F.when(suspect, F.array_distinct(F.filter(words_of(F.col("b_text"), pattern), lambda w: F.octet_length(w) > FOLD_BYTES)))
    udf = _long_words(spark.sparkContext.broadcast(rank_file), pattern)
    rows = slim.withColumn("b_long", udf(long_words))
    rows = _with_tables(rows, pairs=tables.pairs, tokens=tables.tokens, bytes=tables.bytes, words=known)

    def ids_of(t):
        def one(w):
            hit = F.try_element_at(_at(t["words"], F.pmod(F.crc32(w.cast("binary")), F.lit(WORD_BUCKETS))), w)
            folded = F.when(F.octet_length(w) > FOLD_BYTES, F.try_element_at(F.col("b_long"), w)).otherwise(fold_word(w.cast("binary"), t))
            return F.coalesce(hit, folded)

        return F.flatten(F.transform(words_of(F.col("b_text"), pattern), one))

    ids = F.get(F.transform(_tables("pairs", "tokens", "bytes", "words"), ids_of), F.lit(0))
    return rows.select(F.col("b_key").alias(key), ids.alias("ids"))


def decode(encoded: DataFrame, rank_file: bytes, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of ``ids``: each id's piece, concatenated. Null gives null."""
    spark = encoded.sparkSession
    pieces = pieces_of(spark, parse_ranks(rank_file))
    columns = encoded.columns
    bound = encoded.withColumn("b_pieces", pieces.scalar())
    joined = F.get(F.transform(F.array(F.col("b_pieces")), lambda p: F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(p, i)), ""))), F.lit(0))
    return bound.select(*columns, joined.alias(out))
