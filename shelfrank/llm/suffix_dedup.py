"""Operator 12: removal of repeated passages by externally sorted suffixes.

A window is ``length`` consecutive bytes of one document. Shards are cut by
content, so that equal windows meet in one shard whatever documents they lie in: every
window belongs to its anchor, the leftmost k-byte piece of least hash in it, and the
windows in a row with one anchor form a segment. Equal segments are first joined
into a class, inside a batch before the shuffle and over all batches after it; the windows of all its members
but the first are repeats. First members whose anchor has several classes go, by
anchor, to shards of bytes, where the suffixes are sorted by external induction
(:mod:`shelfrank.llm.induced`) and windows whose common prefixes reach
``length`` are repeats of the one that stands first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import mix64, python_ready, written
from shelfrank.llm.importance import _utf8
from shelfrank.llm.induced import Store, suffixes

LENGTH = 100
#: Bytes scanned at once, and segments of a batch that are joined at once.
BLOCK_BYTES, BATCH_SEGMENTS = 1 << 18, 1 << 19
#: Bytes of a shard that are aimed at, shards at most, and memory of a shard's sorter. Beyond so many shards they grow, and the sorter works on disk.
SHARD_BYTES, MOST_SHARDS, MEMORY = 4 << 20, 1 << 16, 128 << 20
#: An anchor with so many different segments in one of SAMPLE documents is dealt window by window, at most MOST_HOT anchors.
HOT_SEEN, SAMPLE, MOST_HOT = 16, 16, 1 << 18
#: Between the segments of a shard; no byte of UTF-8.
_END = 0xFF

_SEGMENT = "kind int, anchor long, c long, key long, tie int, start long, n long"


def _piece(length: int) -> int:
    """Bytes of an anchor: a power of two, a third of a window at most."""
    return 1 << (max(1, length // 3).bit_length() - 1)


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each piece of ``data``, and the place of each window's anchor."""
    k = _piece(length)
    h = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[data]
    s = 1
    while s < k:
        h = h[:-s] * np.uint64(0xD6E8FEB86659FD93) + h[s:]
        h ^= h >> np.uint64(32)
        s *= 2
    h = mix64(h)
    bits = np.uint64((1 << 24) - 1)
    low = (h & ~bits) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    w, s = length - k + 1, 1
    while s * 2 <= w:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if w > s:
        low = np.minimum(low[: len(low) - (w - s)], low[w - s :])
    return h, (low & bits).astype(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """Blocks of ``(row, start in data, windows, anchor hash)`` of all windows of the texts."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + BLOCK_BYTES, end)
        edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
        to = edge if edge > at else to  # whole texts where they fit
        part = data[at : min(to + length - 1, end)]
        if len(part) >= length:
            h, pos = _anchors(part, length)
            starts = np.arange(at, at + len(pos))
            row = np.searchsorted(offsets, starts, "right") - 1
            ok = offsets[row + 1] - starts >= length
            ok[to - at :] = False
            new = ok & np.concatenate([[True], ~ok[:-1] | (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])])
            first = np.flatnonzero(new)
            stop = np.flatnonzero(ok & np.concatenate([~ok[1:] | new[1:], [True]])) + 1
            yield row[first], first + at, stop - first, h[pos[first]].view(np.int64)
        at = to


def _runs(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row of one text, joined (input in any order)."""
    order = np.lexsort((start, row))
    row, start, n = row[order], start[order], n[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(fresh)
    return row[at], start[at], np.add.reduceat(n, at) if len(at) else n


def _cut(length: int, hot: np.ndarray):
    """Task function: texts to their segments' classes (kind 0) and to runs of windows that repeat inside the batch (kind 1)."""

    def flush(batch, order_of, offsets, data, held):
        import xxhash

        view = memoryview(data)
        row, at, n, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        c = np.array([xxhash.xxh3_64_intdigest(view[a : a + m + length - 1]) for a, m in zip(at.tolist(), n.tolist(), strict=True)], dtype=np.uint64).view(np.int64)

        def classes(row, at, n, anchor, c):
            rank, start = order_of[row], at - offsets[row]
            order = np.lexsort((start, rank, c, anchor))
            row, at, n, anchor, c, rank, start = (x[order] for x in (row, at, n, anchor, c, rank, start))
            first = np.ones(len(row), dtype=bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (c[1:] != c[:-1])
            same = np.zeros(len(row), dtype=bool)  # the very same place, in a row of equal id and text
            same[1:] = ~first[1:] & (rank[1:] == rank[:-1]) & (start[1:] == start[:-1])
            again = ~first & ~same
            return (row[first], at[first], n[first], anchor[first], c[first]), (row[again], at[again], n[again])

        kept, again = classes(row, at, n, anchor, c)
        repeats = [again]
        if len(hot):
            found = hot[np.minimum(np.searchsorted(hot, kept[3]), len(hot) - 1)] == kept[3]
            if found.any():  # one window a segment, known by its whole content
                row, at, n = (x[found] for x in kept[:3])
                each = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                keys = np.array([divmod(xxhash.xxh3_128_intdigest(view[a : a + length]), 1 << 64) for a in each.tolist()], dtype=np.uint64).view(np.int64)
                split, again = classes(np.repeat(row, n), each, np.ones(len(each), dtype=np.int64), keys[:, 0], keys[:, 1])
                repeats.append(again)
                kept = tuple(np.concatenate([x[~found], y]) for x, y in zip(kept, split, strict=True))
        row, at, n, anchor, c = kept
        r_row, r_at, r_n = _runs(*(np.concatenate(x) for x in zip(*repeats, strict=True)))
        m = len(r_row)
        rows = np.concatenate([row, r_row])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([0, 1], [len(row), m]).astype(np.int32)), pa.array(np.concatenate([anchor, mix64(r_at.astype(np.uint64)).view(np.int64)])), pa.array(np.concatenate([c, np.zeros(m, dtype=np.int64)])),
            batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.concatenate([at, r_at]) - offsets[rows]), pa.array(np.concatenate([n, r_n])),
        ], names=["kind", "anchor", "c", "key", "tie", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _utf8(batch.column(2))
            ids = [(-1 if k is None else 0, k or 0, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            place = {x: i for i, x in enumerate(sorted(set(ids)))}
            order_of = np.array([place[x] for x in ids], dtype=np.int64)
            held, count = [], 0
            for block in _segments(data, offsets, length):
                held.append(block)
                count += len(block[0])
                if count >= BATCH_SEGMENTS:
                    yield from flush(batch, order_of, offsets, data, held)
                    held, count = [], 0
            if count:
                yield from flush(batch, order_of, offsets, data, held)

    return run


def mark_repeats(segments: Iterator[tuple], length: int, memory: int = MEMORY) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Runs of windows of one shard that also start earlier.

    ``segments`` gives ``(identity, start, bytes)`` in document order; earlier means earlier in it.
    Yields chunks ``(identities, starts, windows)``. Text, marks and segment list lie in temporary files of the task.
    """
    import pickle

    text, marks, ends, starts, names = Store(np.uint8), Store(np.uint8), Store(np.int64), Store(np.int64), []
    lots, piece, flags, size = [], [], [], 0  # marks: 0 a window starts here, 1 it repeats, 2 no window

    def spill():
        nonlocal piece, flags, size
        text.add(np.frombuffer(b"".join(piece), dtype=np.uint8))
        marks.add(np.frombuffer(b"".join(flags), dtype=np.uint8))
        raw = Store(np.uint8)
        raw.add(np.frombuffer(pickle.dumps(names), dtype=np.uint8))
        lots.append((ends.n, raw))
        names.clear()
        piece, flags, size = [], [], 0

    total, before, row_ends, row_starts = 0, None, [], []

    def rows():
        ends.add(np.array(row_ends, dtype=np.int64))
        starts.add(np.array(row_starts, dtype=np.int64))
        row_ends.clear()
        row_starts.clear()

    for name, start, raw in segments:
        if (name, start) == before:  # rows of one id and one text are one document
            continue
        before = (name, start)
        piece += [raw, bytes([_END])]
        flags += [bytes(len(raw) - length + 1), b"\2" * length]
        total += len(raw) + 1
        size += len(raw) + 1
        names.append(name)
        row_ends.append(total)
        row_starts.append(start)
        if size >= 1 << 22:
            rows()
            spill()
    if piece:
        rows()
        spill()
    if not total:
        return
    marked, t = marks.mapped(), text.mapped()
    least = None  # first place of the group that is open at a chunk's end
    held = None  # the last suffix of the chunk before
    for pos, lcp in suffixes(t, total, length, memory, max(1, (length + 1) // 2)):
        near = lcp >= length
        group = np.cumsum(~near)  # 0: still the group that was open before
        if held is not None:
            pos, group = np.append(held, pos), np.append(0, group)
        held = pos[-1:]
        open_group = int(group[-1])
        many = np.append(group[1:] == group[:-1], False)
        many[1:] |= group[1:] == group[:-1]
        many[-1] = many[-1] or (least is not None and open_group == 0)
        p, g = pos[many], group[many]
        inside = marked[p] != 2
        p, g = p[inside], g[inside]
        if least is not None:
            p, g = np.append(least, p), np.append(0, g)
        order = np.lexsort((p, g))
        p, g = p[order], g[order]
        first = np.ones(len(p), dtype=bool)
        first[1:] = g[1:] != g[:-1]
        later = ~first
        later[1:] &= p[1:] != p[:-1]  # the suffix carried over may stand twice
        marked[p[later]] = 1
        mine = p[first & (g == open_group)]
        least = int(mine[0]) if len(mine) else None
    at, done = 0, 0
    for upto, raw in lots:
        if upto == done:
            continue
        ids = pickle.loads(raw.part(0, raw.n).tobytes())
        e, s = ends.part(done, upto), starts.part(done, upto)
        m = np.concatenate([[0], np.asarray(marked[at : e[-1]]) == 1, [0]]).astype(np.int8)
        d = np.diff(m)
        a, b = np.flatnonzero(d == 1) + at, np.flatnonzero(d == -1) + at
        seg = np.searchsorted(e, a, "right")
        begin = np.concatenate([[at], e[:-1]])
        yield [ids[i] for i in seg.tolist()], s[seg] + a - begin[seg], b - a
        at, done = int(e[-1]), upto


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """``key, n_bytes, spans, kept``: each text without the bytes that repeat an earlier window.

    A byte goes if a ``length``-byte string that covers it (in one text) also
    starts earlier: in a document of smaller id, or earlier in the same one. Strings are judged on the
    input. ``spans`` are the maximal removed runs ``(start, n)`` in bytes, ``kept``
    the remaining bytes (binary: a cut may fall inside a character). Ids are integers; a null id comes first. Rows
    of one id and different texts are ordered by a hash of the text; rows of one id
    and one text count as one document and get the same result. Null texts are empty;
    texts shorter than ``length`` stay whole; an empty table gives an empty result. Only ``key`` and ``text`` are read.

    Hashes of 128 bits stand for whole segments where equal ones are joined. Anchors with very many
    different segments, found on a sixteenth of the documents, are dealt window by window, so none of them
    piles up in one shard; this changes where windows meet, not which ones are found.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    slim = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    slim = slim.select("key", F.shiftright(hashed, 32).cast("int").alias("tie"), "text")
    some = slim.where(F.pmod(F.xxhash64("key", "tie"), F.lit(SAMPLE)) == 0)
    crowded = python_ready(some).mapInArrow(_cut(length, np.zeros(0, dtype=np.int64)), _SEGMENT).where("kind = 0").groupBy("anchor").count()
    top = crowded.where(F.col("count") >= HOT_SEEN).orderBy(F.desc("count"), "anchor").limit(MOST_HOT).select("anchor")
    hot = np.sort(np.array([r[0] for r in top.collect()], dtype=np.int64))

    rows = python_ready(slim).mapInArrow(_cut(length, hot), _SEGMENT)
    spot = F.struct("c", "key", "tie", "start")
    w = Window.partitionBy("kind", "anchor").orderBy("c", "key", "tie", "start")
    whole = Window.partitionBy("kind", "anchor").orderBy("c", "key", "tie", "start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.select("*", F.lag(spot).over(w).alias("prev"), (F.first("c").over(whole) != F.last("c").over(whole)).alias("shared"))
    twin = F.coalesce(F.col("prev") == spot, F.lit(False))
    first = F.coalesce(F.col("prev.c") != F.col("c"), F.lit(True))
    found = seen.select(
        F.when(F.col("kind") == 1, 1).when(first, F.when(F.col("shared"), 0)).when(~twin, 1).alias("kind"), "anchor", "key", "tie", "start", "n"
    ).where("kind is not null")
    found = written(found, "segments")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _utf8(b.column(2))
            at, out = offsets[:-1].tolist(), ([], [], [])
            for i, parts in enumerate(b.column(3).to_pylist()):
                for x in parts:
                    out[0].append(x["anchor"])
                    out[1].append(i)
                    out[2].append((x["start"], data[at[i] + x["start"] : at[i] + x["start"] + x["n"] + length - 1].tobytes()))
            i = pa.array(out[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), b.column(0).take(i), b.column(1).take(i), pa.array([x[0] for x in out[2]], pa.int64()), pa.array([x[1] for x in out[2]], pa.binary())], names=["anchor", "key", "tie", "start", "raw"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                for k, t, s, raw in zip(*cols, strict=True):
                    yield (k, t), s, raw

        for ids, starts, n in mark_repeats(rows(), length, memory):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], names=["key", "tie", "start", "n"])

    reps = found.where("kind = 0")
    total = reps.agg(F.sum(F.col("n") + length)).first()[0] or 0
    asked = reps.groupBy(F.col("key").alias("r_key"), F.col("tie").alias("r_tie")).agg(F.collect_list(F.struct("anchor", "start", "n")).alias("parts"))  # bounded by its text
    joined = slim.join(asked, F.col("key").eqNullSafe(F.col("r_key")) & (F.col("tie") == F.col("r_tie")))
    raw = python_ready(joined.select("key", "tie", "text", "parts")).mapInArrow(pieces, "anchor long, key long, tie int, start long, raw binary")
    shards = raw.repartition(min(MOST_SHARDS, max(1, -(-total // shard_bytes))), "anchor").select("key", "tie", "start", "raw").sortWithinPartitions("key", "tie", "start")
    sorted_out = shards.mapInArrow(shard, "key long, tie int, start long, n long")

    spans = found.where("kind = 1").select("key", "tie", "start", "n").unionByName(sorted_out)
    spans = spans.groupBy(F.col("key").alias("r_key"), F.col("tie").alias("r_tie")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _utf8(b.column(1))
            all_spans, kept = [], []
            for i, runs in enumerate(b.column(2).to_pylist()):
                whole = data[offsets[i] : offsets[i + 1]]
                if not runs:
                    all_spans.append([])
                    kept.append(whole.tobytes())
                    continue
                s = np.array([x["start"] for x in runs])
                e = s + np.array([x["n"] for x in runs]) + length - 1
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                fresh = np.append(True, s[1:] > e[:-1])
                s, e = s[fresh], e[np.append(fresh[1:], True)]
                all_spans.append([{"start": x, "n": y - x} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                held = np.zeros(len(whole) + 1, dtype=np.int32)
                np.add.at(held, s, 1)
                np.add.at(held, e, -1)
                kept.append(whole[np.cumsum(held[:-1]) == 0].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(all_spans, kind), pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    last = slim.join(spans, F.col("key").eqNullSafe(F.col("r_key")) & (F.col("tie") == F.col("r_tie")), "left").select("key", "text", "runs")
    out = last.mapInArrow(strip, "key long, n_bytes long, spans array<struct<start: long, n: long>>, kept binary")
    return out.withColumnRenamed("key", key)
