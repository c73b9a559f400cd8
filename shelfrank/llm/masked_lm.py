"""Operator 5: documents scored by masked pseudo-likelihood.

A network sees the words on both sides of a position, never the word itself, and
predicts it; a document's score is the sum of the log-probabilities of all its
words. The network (word vectors, one matrix per place of the window, a hidden
layer, and a softmax over word classes and over the words of a class) is trained
in numpy on the whole table: in each round every task trains a copy on its own
rows, and the copies are averaged by the number of words that they learned from.
The rounds share out the words of every document, so that each is learned from. Words are counted over all
documents; the frequent ones have numbers of their own, the rest share the last
class of numbers by hash, and both grow with the distinct words. A word that
shares its number scores log P(number | context) + log P(word | number), the
second from the smoothed counts of all words, which stay a Spark table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import mix64, python_ready, written

#: Fewest classes, words of a class, and last numbers, which rare words share.
CLASSES, MEMBERS, SHARED = 64, 64, 64
VOCABULARY = CLASSES * MEMBERS
#: The three are the distinct words to this power when that is more: ten times the words, twice the classes.
GROWTH = 0.3
#: What is added to the count of each word of a shared number, and given to all its unseen words together.
SMOOTH = 0.5
#: Words that are seen on each side, and the width of the vectors and the hidden layer.
SIDE, WIDTH = 2, 16
#: Rounds of training, and parts of every document's words: round after round takes the next part.
ROUNDS, PARTS = 2, 2
RATE, STEP_WORDS, MIX_WORDS = 0.15, 1024, 1 << 16
#: Words that are scored at once, text bytes that are cut into words at once, and counts that a task holds.
SCORE_WORDS, CHUNK, HELD = 1 << 15, 1 << 20, 1 << 21
#: Numbers of a part of the network when copies are averaged, and tasks that share the first sums of a part.
PART, SPREAD = 1 << 15, 32

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _letters() -> np.ndarray:
    """A random number for each place in a word (modulo 64) and byte; A-Z as a-z."""
    t = mix64(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(64, 256)
    t[:, 65:91] = t[:, 97:123]
    return t.ravel()


_LETTERS = _letters()


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last one ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _hash_chunk(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word; ``begins``: where texts begin."""
    black = ~_WHITE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    first[begins] = black[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    letters = data[black]
    at = np.cumsum(black)[starts] - 1
    place = np.arange(len(letters)) - np.repeat(at, np.diff(np.append(at, len(letters))))
    return mix64(np.add.reduceat(_LETTERS[(place & 63) * 256 + letters], at)), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text.

    Bytes are read in chunks that end before white space or a text's begin, so a
    long text needs no more memory than its own words."""
    data, offsets = _buffers(texts)
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = at + CHUNK
        if stop < len(data):
            end = int(offsets[np.searchsorted(offsets, stop)])
            while stop < end:
                white = np.flatnonzero(_WHITE[data[stop : min(end, stop + 4096)]])
                if len(white):
                    stop += int(white[0])
                    break
                stop = min(end, stop + 4096)
        stop = min(stop, len(data))
        lo, hi = np.searchsorted(offsets, [at, stop])
        h, s = _hash_chunk(data[at:stop], offsets[lo:hi] - at)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.diff(np.searchsorted(where, offsets))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts in runs of a task's rows."""
    held, size = [], 0

    def out():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    for b in batches:
        for at in range(0, b.num_rows, 1000):
            h, _ = word_hashes(b.column(0).slice(at, 1000))
            held.append(h)
            size += len(h)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def count_words(texts: DataFrame) -> DataFrame:
    """``h, n``: the hash of every word and its count over all texts."""
    return written(python_ready(texts).mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


def side_for(distinct: int) -> int:
    """Classes, words of a class and shared numbers for so many distinct words."""
    return max(CLASSES, math.ceil(distinct**GROWTH))


def _choose(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``vocabulary``, and the distinct words of every shared number."""
    side = side_for(counts.count())
    own = side * side - side
    top = counts.orderBy(F.desc("n"), "h").limit(own).toPandas()  # one row a frequent word
    other = counts.groupBy(F.pmod("h", F.lit(side)).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).toPandas()
    h, n = top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    count, distinct = np.zeros(side * side, np.int64), np.zeros(side, np.int64)
    count[: len(n)] = n
    count[own + other["s"].to_numpy(np.int64)] = other["n"].to_numpy(np.int64)
    distinct[other["s"].to_numpy(np.int64)] = other["d"].to_numpy(np.int64)
    np.subtract.at(count, own + h % side, n)
    np.subtract.at(distinct, h % side, 1)
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], order, count, distinct


def vocabulary(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the most frequent words (sorted), their numbers, and the count of every number.

    Ties in count are broken by hash; numbers go by falling count, so a class
    holds words of like frequency."""
    return _choose(count_words(texts))[:3]


def numbers(hashes: np.ndarray, known: np.ndarray, number: np.ndarray, size: int = VOCABULARY) -> np.ndarray:
    """Words' numbers (uint32) of ``size``."""
    shared = math.isqrt(size)
    rest = size - shared + (hashes.view(np.int64) % shared)
    if not len(known):
        return rest.astype(np.uint32)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, number[at], rest).astype(np.uint32)


def log_totals(count: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Log of each shared number's smoothed count, its unseen words included."""
    return np.log(count[-len(distinct) :] + SMOOTH * (distinct + 1))


def log_unseen(shared: int) -> float:
    """Log of the smoothed count of one unseen word: the hashes of a shared number have equal parts."""
    return math.log(SMOOTH) - 64 * math.log(2) + math.log(shared)


def _rare(h: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """Each document's words of shared numbers, and how often it has each."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    pairs = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["h", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(docs + 1)).astype(np.int32)), pairs)


_IDS = "ids binary, totals double, rare array<struct<h: bigint, times: bigint>>"


def _encode(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, number, size, totals = shared.value
    own = size - len(totals)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            h, n = word_hashes(part.column(2))
            num, ends = numbers(h, known, number, size), np.concatenate([[0], np.cumsum(n)]) * 4
            raw, rest = num.tobytes(), np.flatnonzero(num >= own)
            doc = np.repeat(np.arange(len(n)), n)[rest]
            ids = pa.array([raw[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            sums = np.bincount(doc, totals[num[rest] - own], len(n))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, pa.array(sums, pa.float64()), _rare(h[rest], doc, len(n))], names=["row", "k", "ids", "totals", "rare"])


class Network:
    """The window network; all its numbers lie in one vector."""

    @staticmethod
    def shapes(side: int) -> dict[str, tuple[int, ...]]:
        """Of a network with ``side`` classes of ``side`` words."""
        size = side * side
        return {"words": (size + 1, WIDTH), "window": (2 * SIDE * WIDTH, WIDTH), "hidden": (WIDTH,), "classes": (side, WIDTH), "class_bias": (side,), "members": (size, WIDTH), "member_bias": (size,)}

    @classmethod
    def length(cls, side: int) -> int:
        return sum(math.prod(s) for s in cls.shapes(side).values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        self.side = math.isqrt(len(flat) // (2 * WIDTH + 1))  # less the places that don't grow with the square
        while self.length(self.side) > len(flat):
            self.side -= 1
        self.size = self.side * self.side
        for name, shape in self.shapes(self.side).items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, count: np.ndarray, seed: int) -> Network:
        """Random vectors; the biases give the words' frequencies."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.length(math.isqrt(len(count))), np.float32))
        net.words[:] = rng.normal(0, 0.3, net.words.shape)
        net.window[:] = rng.normal(0, 1 / np.sqrt(net.window.shape[0]), net.window.shape)
        by_class = (count + 0.5).reshape(net.side, net.side)
        net.class_bias[:] = np.log(by_class.sum(1) / by_class.sum())
        net.member_bias[:] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
        return net

    def hide(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = self.words.take(around, 0).reshape(len(around), -1)
        h = seen @ self.window
        h += self.hidden
        return seen, np.tanh(h, out=h)

    def log_prob(self, target: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log-probability of each word by the words around it."""
        h = self.hide(around)[1]
        kind, member = np.divmod(target.astype(np.int64), self.side)
        out = _log_softmax(h @ self.classes.T, self.class_bias, kind).astype(np.float64)
        order = _order(kind, self.side)  # words of a class side by side
        h, member, inside = h.take(order, 0), member[order], np.empty(len(h), h.dtype)
        for c, at in _runs(kind[order]):
            rows = slice(c * self.side, (c + 1) * self.side)
            inside[at] = _log_softmax(h[at] @ self.members[rows].T, self.member_bias[rows], member[at])
        out[order] += inside
        return out

    def learn(self, target: np.ndarray, around: np.ndarray, past: Network) -> None:
        """One step of Adagrad; ``past`` holds the sums of squared gradients.

        Arrays are worked on in place: new ones of this size cost more than the sums."""
        n, side = len(target), self.side
        kind = target // side
        order = _order(kind, side)  # words of a class side by side
        target, around, kind = target[order].astype(np.int64), around[order], kind[order].astype(np.int64)
        seen, h = self.hide(around)
        runs = list(_runs(kind))
        first = np.array([at.start for _, at in runs])
        g = _softmax_error(h @ self.classes.T + self.class_bias, kind)
        to_hidden = g @ self.classes
        self._move("classes", slice(None), g.T @ h, past)
        self._move("class_bias", slice(None), g.sum(0), past)
        words, biases = self.members.reshape(side, side, WIDTH), self.member_bias.reshape(side, side)
        g = np.empty((n, side), h.dtype)
        for c, at in runs:
            x = np.matmul(h[at], words[c].T, out=g[at])
            x += biases[c]
        _softmax_error(g, target - kind * side)
        members, back = np.empty((len(runs), side, WIDTH), h.dtype), np.empty_like(to_hidden)
        for i, (c, at) in enumerate(runs):
            np.matmul(g[at], words[c], out=back[at])
            np.matmul(g[at].T, h[at], out=members[i])
        to_hidden += back
        bias = np.add.reduceat(g, first)
        self._move("members", kind[first], members, past)  # classes without a word here don't move
        self._move("member_bias", kind[first], bias, past)
        to_hidden *= 1 - h * h
        to_seen = (to_hidden @ self.window.T).reshape(-1, WIDTH)
        self._move("window", slice(None), seen.T @ to_hidden, past)
        self._move("hidden", slice(None), to_hidden.sum(0), past)
        ids = around.ravel()
        order = _order(ids, self.size + 1)
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        self._move("words", ids[first], np.add.reduceat(to_seen.take(order, 0), first), past)

    def _move(self, name: str, rows, g: np.ndarray, past: Network) -> None:
        """Moves some rows (of ``members`` and their biases: some classes) against their gradient, which is used up."""
        squares, values = getattr(past, name), getattr(self, name)
        if name.startswith("member"):
            squares, values = (x.reshape(self.side, *g.shape[1:]) for x in (squares, values))
        s = g * g
        s += squares[rows]
        squares[rows] = s
        np.sqrt(s, out=s)
        s += 1e-4
        g *= RATE
        g /= s
        values[rows] -= g


def _order(x: np.ndarray, top: int) -> np.ndarray:
    """Stable order of numbers below ``top``; short ones are sorted by their bytes, in linear time."""
    return np.argsort(x.astype(np.uint16) if top <= 1 << 16 else x, kind="stable")


def _runs(kind: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each class of sorted ``kind`` and its words."""
    first = np.flatnonzero(np.diff(kind, prepend=-1)).tolist()
    for a, z in zip(first, [*first[1:], len(kind)], strict=True):
        yield int(kind[a]), slice(a, z)


def _softmax_error(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """In place: probabilities, less 1 at the target."""
    g = np.exp(logits, out=logits)
    g /= g.sum(1, keepdims=True)
    g[np.arange(len(g)), target] -= 1
    return g


def _log_softmax(logits: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target; the logits are used up."""
    logits += bias
    own = logits[np.arange(len(logits)), target]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def windows(ids: list[bytes], blank: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some documents with ``SIDE`` blanks (the number after the last) around each document: the
    padded row, the words' places in it, their document and their place in that."""
    n = np.array([len(x) // 4 for x in ids], np.int64)
    doc = np.repeat(np.arange(len(ids)), n)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(doc)) + SIDE * (doc + 1)
    row = np.full(len(doc) + SIDE * (len(ids) + 1), blank, np.int64)
    row[at] = np.frombuffer(b"".join(ids), np.uint32)
    return row, at, doc, inside


_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def _groups(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of about ``limit`` words, and the first one's row."""
    held, size, first = [], 0, 0
    for i, x in enumerate(column.to_pylist()):
        held.append(x)
        size += len(x) // 4
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def of_round(inside: np.ndarray, turn: int, parts: int) -> np.ndarray:
    """Whether round ``turn`` learns from a document's word ``inside``."""
    return (inside + turn) % parts == 0


def _train(shared, turn: int, parts: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net = Network(shared.value.copy())
    past = Network(np.zeros_like(net.flat))
    rng = np.random.default_rng([seed, turn])
    learned, held, size = 0, [], 0

    def learn():
        target, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = rng.permutation(len(target))
        for i in range(0, len(order), STEP_WORDS):
            net.learn(target[order[i : i + STEP_WORDS]], around[order[i : i + STEP_WORDS]], past)
        return len(target)

    for b in batches:
        for _, ids in _groups(b.column(0), MIX_WORDS):
            row, at, _, inside = windows(ids, net.size)
            at = at[of_round(inside, turn, parts)]
            for i in range(0, len(at), MIX_WORDS):
                some = at[i : i + MIX_WORDS]
                held.append((row[some], row[some[:, None] + _AROUND]))
                size += len(some)
                if size >= MIX_WORDS:
                    learned += learn()
                    held, size = [], 0
    if size:
        learned += learn()
    if learned:
        parts = [net.flat[i : i + PART] for i in range(0, len(net.flat), PART)]
        salt = int(rng.integers(1 << 30)) ^ learned
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([salt % SPREAD] * len(parts), pa.int32()), pa.array([float(learned)] * len(parts)), pa.array([(x.astype(np.float64) * learned).tobytes() for x in parts], pa.binary())],
            names=["part", "salt", "weight", "sums"],
        )


_SUMS = "part int, salt int, weight double, sums binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the copies of each part of the network that reach a task."""
    weight: dict[int, float] = {}
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, w, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            x = np.frombuffer(raw.as_py(), np.float64)
            weight[part] = weight.get(part, 0.0) + w
            sums[part] = sums[part] + x if part in sums else x
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.nulls(len(keys), pa.int32()), pa.array([weight[k] for k in keys], pa.float64()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["part", "salt", "weight", "sums"])


def _average(copies: DataFrame, before: np.ndarray) -> np.ndarray:
    """The copies' mean, by weight: summed per (part, salt), then per part; one network reaches the driver."""
    first = copies.repartition("part", "salt").mapInArrow(_add_up, _SUMS)
    rows = first.repartition("part").mapInArrow(_add_up, _SUMS).collect()
    if not rows:
        return before
    return np.concatenate([np.frombuffer(r["sums"], np.float64) / r["weight"] for r in sorted(rows, key=lambda r: r["part"])]).astype(np.float32)


def train(ids: DataFrame, count: np.ndarray, *, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """The network after ``rounds`` over the documents' numbers (``ids``, binary);
    ``PARTS`` rounds, or one if there is no other, learn from every word once."""
    net = Network.start(count, seed)
    for turn in range(rounds):
        shared = ids.sparkSession.sparkContext.broadcast(net.flat)  # one network
        copies = python_ready(ids.select("ids")).mapInArrow(functools.partial(_train, shared, turn, max(1, min(rounds, PARTS)), seed), _SUMS)
        net = Network(_average(copies, net.flat))
    return net


def _score(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    net = Network(shared.value)
    for b in batches:
        total, n = -b.column(3).to_numpy(), np.zeros(b.num_rows, np.int64)
        for first, ids in _groups(b.column(2), MIX_WORDS):
            row, at, doc, _ = windows(ids, net.size)
            for i in range(0, len(at), SCORE_WORDS):
                some = at[i : i + SCORE_WORDS]
                total[first : first + len(ids)] += np.bincount(doc[i : i + SCORE_WORDS], net.log_prob(row[some], row[some[:, None] + _AROUND]), len(ids))
            n[first : first + len(ids)] = np.bincount(doc, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(total)], names=["row", "k", "n_words", "score"])


def encode_words(docs: DataFrame, key: str, text: str, counts: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """``row, k, ids, totals, rare`` of every row, and the count of every number: the
    words' numbers (binary of uint32), the sum of ``log_totals`` over the words of
    shared numbers, and those words with their counts in the row."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("t"))
    known, number, count, distinct = _choose(counts if counts is not None else count_words(texts.select("t")))
    shared = docs.sparkSession.sparkContext.broadcast((known, number, len(count), log_totals(count, distinct)))  # at most one row a number
    kind = texts.schema["k"].dataType.simpleString()
    return written(python_ready(texts).mapInArrow(functools.partial(_encode, shared), f"row long, k {kind}, {_IDS}"), "lm-ids"), count


def rare_worth(ids: DataFrame, counts: DataFrame, shared: int) -> DataFrame:
    """``row, worth``: the log smoothed counts of a row's words of shared numbers, summed.

    A pair of row and word comes once, and no word here is among the frequent
    ones, so none has more than one in ``VOCABULARY - SHARED`` of all words: the
    join needs no salt."""
    pairs = ids.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times")
    known = counts.select("h", F.log(F.col("n") + F.lit(SMOOTH)).alias("each"))
    worth = F.sum(F.col("times") * F.coalesce("each", F.lit(log_unseen(shared))))
    return pairs.join(known, "h", "left").groupBy("row").agg(worth.alias("worth"))


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seed: int = 5) -> DataFrame:
    """``key, n_words, log_likelihood, mean_log_prob`` for every row.

    Null, empty and white texts have no words, a sum of 0 and a null mean; rows
    that repeat are learned from and scored each; ties in word counts are broken
    by the words' hashes; an empty table gives an empty result; extra columns
    are not read.
    """
    counts = count_words(docs.select(text))
    ids, count = encode_words(docs, key, text, counts)
    shared = docs.sparkSession.sparkContext.broadcast(train(ids, count, rounds=rounds, seed=seed).flat)  # one network
    kind = ids.schema["k"].dataType.simpleString()
    slim = python_ready(ids.select("row", "k", "ids", "totals"))
    scored = slim.mapInArrow(functools.partial(_score, shared), f"row long, k {kind}, n_words long, score double")
    both = scored.join(rare_worth(ids, counts, math.isqrt(len(count))), "row", "left")
    both = both.withColumn("log_likelihood", F.col("score") + F.coalesce("worth", F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return both.select(F.col("k").alias(key), "n_words", "log_likelihood", mean.alias("mean_log_prob"))
