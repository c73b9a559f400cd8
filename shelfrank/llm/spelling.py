"""Operator 11: grouping of spelling variants by a bit-sliced position index.

Words of the vocabulary that differ by one inserted, deleted or replaced letter
are found among words that agree in the first or in the second half of the shorter
one. Inside such a share of the vocabulary, a bitset per (position, letter) says
which words have the letter there; for a block of words all bitsets advance
together: one set of words without an error so far, and two sets with one error,
without and with a shift of positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written
from shelfrank.llm.importance import _advance, _utf8

#: Texts are read in blocks of about so many bytes; a task hands on its counts at so many distinct words.
BLOCK_BYTES, MOST_WORDS = 1 << 21, 1 << 18
#: Words that share a half are split by the halves of what is left beyond so many.
CROWD = 4096
#: Words of a share of the vocabulary, about.
SHARE = 2048
#: Bits of a block of words against a share that are unpacked at once.
BLOCK_BITS = 1 << 23

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = (_LOWER >= 0x61) & (_LOWER <= 0x7A)
#: U+00C0 to U+00FF are the pairs 0xC3, 0x80 to 0xBF of UTF-8.
_LEAD = 0xC3


def _ids(batch_ids: list) -> np.ndarray:
    """CRC registers after ``<id>:`` (null: nothing before the colon)."""
    return np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) ^ 0xFFFFFFFF for i in batch_ids], dtype=np.uint32)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK_BYTES`` that cut no run of letters."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + BLOCK_BYTES, end)
        edge = int(offsets[np.searchsorted(offsets, to)])
        while to < edge:  # a space or other ASCII mark is never inside a run
            part = data[to : min(to + BLOCK_BYTES, edge)]
            off = np.flatnonzero((part < 0x80) & ~_LETTER[_LOWER[part]])
            if len(off):
                to += int(off[0])
                break
            to = min(to + BLOCK_BYTES, edge)
        yield at, to
        at = to


def _count_block(low: np.ndarray, cuts: np.ndarray, doc_at: np.ndarray, start_crc: np.ndarray, drop: int, least: int, total: dict) -> None:
    """Adds the words of one block of lower-cased bytes to ``total``; ``cuts`` flags where texts begin."""
    lead = low == _LEAD
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    s = np.flatnonzero(inside & (~before | cuts[:-1]))
    e = np.flatnonzero(inside & (~after | cuts[1:])) + 1
    if not len(s):
        return
    chars = np.concatenate([[0], np.cumsum(lead)])
    sizes = e - s
    points = sizes - (chars[e] - chars[s])
    doc = np.searchsorted(doc_at, s, "right") - 1
    order = np.argsort(sizes, kind="stable")
    order = order[points[order] >= least]
    values, at = np.unique(sizes[order], return_index=True)
    for size, group in zip(values.tolist(), np.split(order, at[1:]), strict=True):
        for part in np.split(group, range(0, len(group), max(1, BLOCK_BYTES * 4 // size))[1:]):
            rows = low[s[part][:, None] + np.arange(size)]
            hit = (_advance(start_crc[doc[part]], rows) ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
            cut = hit % drop == 0
            for k in np.flatnonzero(cut).tolist():  # one in ``drop``
                word = rows[k].tobytes().decode()
                p = int(hit[k]) % len(word)
                word = word[:p] + word[p + 1 :]
                if len(word) >= least:
                    total[word.encode()] = total.get(word.encode(), 0) + 1
            rows = rows[~cut]
            if len(rows):
                keys = np.ascontiguousarray(rows).view(f"V{size}")[:, 0] if size > 8 else np.pad(rows, ((0, 0), (0, 8 - size))).view(np.uint64)[:, 0]
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                for word, k in zip((rows[f].tobytes() for f in first), n.tolist(), strict=True):
                    total[word] = total.get(word, 0) + k


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", drop: int = 97, least: int = 5, seen: int = 3) -> DataFrame:
    """``word, n``: words of ``least`` letters or more that occur ``seen`` times or more.

    A word is a maximal run of ASCII letters and U+00C0 to U+00FF, lower-cased in A-Z
    only. Where ``drop`` divides the CRC-32 h of ``<id>:<word>``, the letter at
    h modulo the length is taken out of it first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()

        for b in batches:
            data, offsets = _utf8(b.column(1))
            crc = _ids(b.column(0).to_pylist())
            for at, to in _blocks(data, offsets):
                cuts = np.zeros(to - at + 1, dtype=bool)
                cuts[0] = cuts[-1] = True
                cuts[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
                _count_block(_LOWER[data[at:to]], cuts, offsets - at, crc, drop, least, total)
                if len(total) >= MOST_WORDS:
                    yield from out()
        yield from out()

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string"))
    parts = python_ready(slim).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


class PositionIndex:
    """Bitsets over words of ``size`` or ``size + 1`` letters, one per (position, letter)."""

    def __init__(self, words: list[str], size: int):
        self.n, self.size = len(words), size
        self.codes = np.array(words, dtype=f"U{size + 1}").view(np.uint32).reshape(self.n, size + 1)
        self.wide = -(-self.n // 64)
        self.longer = self.codes[:, size] != 0

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(flags, axis=-1, bitorder="little")
        return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, self.wide * 8 - packed.shape[-1])]).view(np.uint64)

    def letters(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters at position ``p`` and their bitsets; one empty bitset stands at the end."""
        kinds = np.unique(self.codes[:, p])
        sets = self._pack(self.codes[:, p][None, :] == kinds[:, None])
        return kinds, np.vstack([sets, np.zeros((1, self.wide), dtype=np.uint64)])

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(shorter or equal word, other word)`` one error apart; pairs of equal length once."""
        asked = np.flatnonzero(~self.longer)
        ends = self._pack(~self.longer), self._pack(self.longer)
        step = max(1, BLOCK_BITS // max(self.n, 1))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            full = np.full((len(q), self.wide), ~np.uint64(0))
            none, one, shifted = full, np.zeros_like(full), full.copy()  # no error; one without, one with a shift
            here = self.letters(0)
            for p in range(self.size):
                there = self.letters(p + 1)
                c = self.codes[q, p]

                def have(level, c=c):
                    k = np.minimum(np.searchsorted(level[0], c), len(level[0]) - 1)
                    return level[1][np.where(level[0][k] == c, k, len(level[0]))]

                same, moved = have(here), have(there)
                one = (one & same) | (none & ~same)
                none = none & same
                shifted = (shifted & moved) | none
                here = there
            found = (one & ends[0]) | (shifted & ends[1])
            i, j = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.n])
            i = q[i]
            keep = self.longer[j] | (i < j)
            yield i[keep], j[keep]


def _kin(path: str, a: str, b: str) -> bool:
    """Whether this share is the one that reports the pair: the first half wherever it agrees, else the second."""
    size, left, right = len(a), 0, 0  # a is the shorter one
    for side in path:
        half = (size - left - right) // 2
        if (a[left : left + half] == b[left : left + half]) != (side == "p"):
            return False
        left, right = (left + half, right) if side == "p" else (left, size - left - half)
    return True


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One share (a group's rows): each word's near words here, how many and the most frequent."""
    table = pa.Table.from_batches(list(batches))
    size = np.array(table.column("size"))
    paths, words, counts = (table.column(x).to_pylist() for x in ("path", "word", "n"))
    keys = np.array(table.column("key"))
    out: dict[int, list] = {}
    for path, m in sorted({(p, int(s)) for p, s in zip(paths, size.tolist(), strict=True)}):
        rows = np.array([i for i in np.flatnonzero(size == m).tolist() if paths[i] == path])
        _, place, many = np.unique(keys[rows], return_inverse=True, return_counts=True)
        rows = rows[many[place] > 1]
        if not len(rows):
            continue
        for i, j in PositionIndex([words[r] for r in rows], m).near():
            for a, b in zip(rows[i].tolist(), rows[j].tolist(), strict=True):
                if keys[a] == keys[b] and _kin(path, words[a], words[b]):
                    for x, y in ((a, b), (b, a)):
                        o, rank = out.setdefault(x, [0, None]), (-counts[y], words[y])
                        o[0] += 1
                        if o[1] is None or rank < o[1]:
                            o[1] = rank
    yield pa.RecordBatch.from_arrays([
        pa.array([words[x] for x in out], pa.string()), pa.array([o[0] for o in out.values()], pa.int64()),
        pa.array([o[1][0] for o in out.values()], pa.int64()), pa.array([o[1][1] for o in out.values()], pa.string()),
    ], names=["word", "n_near", "less", "other"])


def _halves() -> Column:
    """Both halves of what is open of a word between ``a`` letters in front and ``b`` at the end."""
    half = F.floor((F.col("size") - F.col("a") - F.col("b")) / 2).cast("int")
    front = F.struct(F.concat("path", F.lit("p")).alias("path"), (F.col("a") + half).alias("a"), F.col("b").alias("b"))
    back = F.struct(F.concat("path", F.lit("s")).alias("path"), F.col("a").alias("a"), (F.col("size") - F.col("a") - half).cast("int").alias("b"))
    return F.explode(F.array(front, back))


def _shares(words: DataFrame) -> DataFrame:
    """``words`` (``word, n, size, path, a, b``) under the keys of both halves of what is open."""
    split = words.select("word", "n", "size", _halves().alias("h")).select("word", "n", "size", "h.*")
    fixed = F.concat(F.expr("substring(word, 1, a)"), F.lit(" "), F.expr("right(word, b)"))
    return split.withColumn("key", F.xxhash64("size", "path", fixed))


def near_words(vocab: DataFrame, *, least: int = 5, crowd: int = CROWD, share: int = SHARE) -> DataFrame:
    """``word, n_near, less, other`` for words with a near word: how many, minus the largest ``n``, and whose it is.

    A word enters for its own length and, as the longer one of a pair, for one letter less. Crowded keys are
    split by halves again until they hold ``crowd`` words at most or one letter is open,
    when a key holds the alphabet's square at most.
    """
    size = F.char_length("word")
    start = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).where(F.col("size") >= least)
    level = written(_shares(start.select("*", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"))), "halves")
    done = []
    while True:
        crowded = level.where("size - a - b > 1").groupBy("key").count().where(F.col("count") > crowd).select("key")
        crowded = written(crowded, "crowded")
        if crowded.isEmpty():
            done.append(level)
            break
        done.append(level.join(crowded, "key", "left_anti"))
        level = written(_shares(level.join(crowded, "key", "left_semi").drop("key")), "halves")
    entries = done[0]
    for more in done[1:]:
        entries = entries.unionByName(more)
    shares = max(1, -(-entries.count() // share))
    dealt = python_ready(entries.select("word", "n", "size", "path", "key", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shares)).alias("bucket")))
    kind = "word string, n_near long, less long, other string"
    found = dealt.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches(list(_best(iter(t.to_batches())))), kind)
    best = F.min(F.struct("less", "other"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.less", "best.other")


def group_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", drop: int = 97, least: int = 5, seen: int = 3, times: int = 2, crowd: int = CROWD, share: int = SHARE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of :func:`vocabulary`.

    ``form`` is the near word (one letter inserted, deleted or replaced) of largest
    ``n``, ties to the smallest in code-point order, if its ``n`` is ``times`` the word's or more, else
    null; ``root`` follows forms to the last. Null and empty texts have no words; a
    null id stands as nothing before the colon; repeated rows count again; an
    empty table gives an empty result. Words of any length are whole. Other columns of ``docs`` are not read.
    """
    vocab = written(vocabulary(docs, key=key, text=text, drop=drop, least=least, seen=seen), "vocabulary")
    near = near_words(vocab, least=least, crowd=crowd, share=share)
    fits = F.col("less") <= -times * F.col("n")
    words = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("other")).alias("form"), F.when(fits, -F.col("less")).alias("form_n")
    )
    words = written(words, "forms")
    ups = words.select("word", F.col("form").alias("up"))
    while True:  # every round doubles the steps; n grows by ``times`` a step, so rounds are few
        above = ups.where("up is not null").select(F.col("word").alias("w"), F.col("up").alias("next"))
        step = ups.join(above, F.col("up") == F.col("w"), "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        ups = written(step, "roots")
        if ups.where("moved").isEmpty():
            break
    roots = ups.select("word", F.coalesce("up", "word").alias("root"))
    return words.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
