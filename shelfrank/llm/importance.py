"""Operator 13: importance resampling towards the texts of a target collection.

Features are runs of words, hashed into buckets by their CRC-32. The CRCs of a
block of texts are found together: its distinct features of equal length form a
two-dimensional byte matrix whose CRCs advance one column at a time, and buckets
are scattered back to the features' places. A bucket's gain says how much likelier it
is in the target than in the documents; the best ``share`` of the documents by
mean gain plus Gumbel noise from the id is drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written
from shelfrank.llm.sharding import number_rows

BUCKETS = 10_000
#: Texts are read in blocks of about so many bytes, cut between words.
BLOCK_BYTES = 1 << 21
#: Longer features enter the matrix as rows of so many bytes, joined afterwards.
ROW_BYTES = 64

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def _advance(crc: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """CRC registers of all rows after the columns of ``matrix``, one at a time."""
    for j in range(matrix.shape[1]):
        crc = _TABLE[(crc ^ matrix[:, j]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc


def _behind(zeros: int) -> np.ndarray:
    """4 x 256 table that moves a register past ``zeros`` zero bytes, byte by byte of the register."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _advance(one, np.zeros((32, 1), dtype=np.uint8))  # past one byte, bit by bit
    total, power = one, step

    def apply(m, x):
        out = np.zeros(len(x), dtype=np.uint32)
        for b in range(32):
            out ^= np.where((x >> np.uint32(b)) & np.uint32(1), m[b], np.uint32(0))
        return out

    while zeros:
        if zeros & 1:
            total = apply(power, total)
        power = apply(power, power)
        zeros >>= 1
    return np.stack([apply(total, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


_MOVES: dict[int, np.ndarray] = {}


def crc_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a byte matrix (rows of one length).

    Rows over ``ROW_BYTES`` are cut into short rows first, with zeros in front,
    which leave an empty register as it is; registers of neighbours are then joined
    two by two, so the columns of a step stay few for any length.
    """
    n, length = matrix.shape
    if length <= ROW_BYTES:
        return _advance(np.full(n, 0xFFFFFFFF, dtype=np.uint32), matrix) ^ np.uint32(0xFFFFFFFF)
    pieces = 1 << (-(-length // ROW_BYTES) - 1).bit_length()
    padded = np.zeros((n, pieces * ROW_BYTES), dtype=np.uint8)
    padded[:, -length:] = matrix
    crc = _advance(np.zeros(n * pieces, dtype=np.uint32), padded.reshape(-1, ROW_BYTES)).reshape(n, pieces)
    wide = ROW_BYTES
    while crc.shape[1] > 1:
        if wide not in _MOVES:
            _MOVES[wide] = _behind(wide)
        left, t = crc[:, ::2], _MOVES[wide]
        for k in range(4):
            left = left if k else np.zeros_like(crc[:, ::2])
            left = left ^ t[k][(crc[:, ::2] >> np.uint32(8 * k)) & np.uint32(255)]
        crc, wide = left ^ crc[:, 1::2], wide * 2
    return crc[:, 0] ^ np.uint32(zlib.crc32(bytes(length)))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct row, and each row's place among these."""
    n, length = rows.shape
    if length <= 8:
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :length] = rows
        keys = wide.view(np.uint64)[:, 0]
    else:
        keys = np.ascontiguousarray(rows).view(f"V{length}")[:, 0]
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return first, place.reshape(-1)


def feature_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every slice ``data[start:end]``: groups of equal length, each a matrix of its distinct rows."""
    out = np.zeros(len(starts), dtype=np.int64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    values, at = np.unique(lengths[order], return_index=True)
    for length, group in zip(values.tolist(), np.split(order, at[1:]), strict=True):
        for part in np.split(group, range(0, len(group), max(1, BLOCK_BYTES * 4 // length))[1:]):
            rows = data[starts[part][:, None] + np.arange(length)]
            first, place = _distinct(rows)
            out[part] = (crc_rows(rows[first]).astype(np.int64) % buckets)[place]
    return out


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and where its texts begin and end."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data, offsets


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK_BYTES`` that cut no word."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + BLOCK_BYTES, end)
        edge = int(offsets[np.searchsorted(offsets, to)])  # the end of the text that `to` lies in
        while to < edge:
            off = np.flatnonzero(~_IN_WORD[data[to : min(to + BLOCK_BYTES, edge)]])
            if len(off):
                to += int(off[0])
                break
            to = min(to + BLOCK_BYTES, edge)
        yield at, to
        at = to


def _words(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the block, its words' starts, ends and texts."""
    low = _LOWER[data[at:to]]
    inside = _IN_WORD[low]
    cut = np.zeros(len(low) + 1, dtype=bool)  # a text begins here
    cut[0] = cut[-1] = True
    cut[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
    before = np.concatenate([[False], inside])[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside, [False]])[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts + at, "right") - 1


def _features(data, offsets, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of ``(text, bucket)`` of every run of one to ``longest`` words, and ``(text, -1)`` once a word."""
    tail = None  # the last words of the text so far, for runs that reach over a block's end
    for at, to in _blocks(data, offsets):
        low, s, e, doc = _words(data, offsets, at, to)
        if longest > 1:
            sizes = e - s + 1
            new = np.concatenate([[0], np.cumsum(sizes)])
            joined = np.full(int(new[-1]), 32, dtype=np.uint8)
            move = np.repeat(s - new[:-1], sizes - 1)
            held = np.ones(len(joined), dtype=bool)
            held[new[1:] - 1] = False
            spots = np.flatnonzero(held)
            joined[spots] = low[spots + move]
            low, s, e = joined, new[:-1], new[1:] - 1
            if tail is not None and len(s):
                low, shift = np.concatenate([tail[0], low]), len(tail[0])
                s, e, doc = (np.concatenate([tail[1], s + shift]), np.concatenate([tail[2], e + shift]), np.concatenate([tail[3], doc]))
        fresh = 0 if tail is None or longest == 1 or not len(s) else len(tail[1])
        for n in range(1, longest + 1):
            k = np.arange(max(0, len(s) - n + 1))
            k = k[(doc[k] == doc[k + n - 1]) & (k + n - 1 >= fresh)]
            if len(k):
                yield doc[k], feature_buckets(low, s[k], e[k + n - 1], buckets)
        if longest > 1 and len(s):
            keep = min(longest - 1, len(s))
            base = int(s[-keep])
            tail = (np.concatenate([low[base:], np.full(1 if low[-1] != 32 else 0, 32, dtype=np.uint8)]), s[-keep:] - base, e[-keep:] - base, doc[-keep:])


def count_buckets(texts: DataFrame, *, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket (every bucket has a row).

    A task hands on one sum a bucket, whatever it reads.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, at in _features(*_utf8(b.column(0)), longest, buckets):
                total += np.bincount(at, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = python_ready(texts.select(F.col(text).cast("string"))).mapInArrow(count, "bucket long, n long")
    every = texts.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(every).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs_n: DataFrame, target_n: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket: thousandths of the log ratio of its smoothed shares. One row a bucket comes to the driver."""
    both = docs_n.select("bucket", F.col("n").alias("s")).join(target_n.select("bucket", F.col("n").alias("t")), "bucket")
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    rows = both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()  # one row on the right
    gains = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        gains[r["bucket"]] = r["gain"]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray, *, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``key, n_words, n_features, weight``: the floored mean gain of a text's features, 0 without any."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = len(b)
            n, total, words = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            data, offsets = _utf8(b.column(1))
            for doc, at in _features(data, offsets, longest, len(gains)):
                n += np.bincount(doc, minlength=rows)
                total += np.bincount(doc, weights=gains[at], minlength=rows).astype(np.int64)  # sums below 2^53
            if longest == 1:
                words = n
            else:
                for at, to in _blocks(data, offsets):
                    words += np.bincount(_words(data, offsets, at, to)[3], minlength=rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (words, n, total // np.maximum(n, 1)))], names=["key", "n_words", "n_features", "weight"])

    return python_ready(slim).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def gumbel(key: str, seed: int) -> Column:
    """Floored thousandths of Gumbel noise from the first 32 bits of ``sha256('<seed>:<id>')`` (null id: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every document; ``rank`` is null unless drawn.

    Words are runs of ASCII letters, digits and characters past ASCII, lower-cased
    in A-Z only; features are runs of one to ``longest`` words joined by a space.
    Of the N documents with ``least_words`` words or more the ``percent * N // 100``
    highest scores are drawn, ties to the smaller id (a null id comes first).
    Null and empty texts have no features and weight 0. Rows of one id have one
    noise; rows equal in score and id take neighbouring ranks in any order, which
    gives the same table. An empty table gives an empty result; an empty target
    makes every gain that of smoothing alone. Other columns of ``docs`` are not read.
    """
    gains = bucket_gains(
        count_buckets(docs, text=text, longest=longest, buckets=buckets), count_buckets(target, text=target_text, longest=longest, buckets=buckets), buckets
    )
    weighed = weigh(docs.withColumnRenamed(key, "r_key"), gains, key="r_key", text=text, longest=longest)
    scored = weighed.withColumn("score", F.col("weight") + gumbel("r_key", seed))
    scored = written(scored.withColumn("r_out", F.col("n_words") < least_words).withColumn("r_low", -F.col("score")), "weighed")
    drawn = scored.where(~F.col("r_out")).count() * percent // 100
    ranked = number_rows(scored, ["r_out", "r_low", "r_key"])
    rank = F.when(~F.col("r_out") & (F.col("row_no") < drawn), F.col("row_no") + 1).cast("long")
    return ranked.select(F.col("r_key").alias(key), "n_features", "weight", "score", rank.alias("rank"))
