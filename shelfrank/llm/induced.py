"""External induced sorting of suffixes, with common prefixes up to a bound.

The text, the suffix lists and the priority queues lie in nameless temporary files of the task
(they end with it; no other task reads them); what is held in memory is bounded by ``memory`` bytes, whatever the
text's length. One level works so: the leftmost-S suffixes (those at a local
minimum) are bucketed by first character and one induction sorts their
substrings; these are named, the string of names is sorted by the same level again
(in memory once it fits), and a second induction derives the order of all
suffixes from the order of the leftmost-S ones. An induction sweeps the
characters up and then down; a suffix taken from the queue puts its left neighbour
into the queue. The second induction also carries for each tuple the length of the common prefix
with its predecessor: one more than the least value seen since the last tuple put
under the same character.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Suffixes taken from a queue at once.
CHUNK = 1 << 16


#: Bytes of one array that stay in memory before it moves to its file.
ROOM = 1 << 22


class Store:
    """An append-only array in a temporary file (or in memory, while it is short), readable in both directions."""

    def __init__(self, dtype, room: int = ROOM):
        self.file, self.dtype, self.n, self.room = None, np.dtype(dtype), 0, room
        self.parts: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        if self.file is None:
            self.parts.append(np.array(values, dtype=self.dtype))
            if self.n * self.dtype.itemsize > self.room:
                self.file = tempfile.TemporaryFile()
                for p in self.parts:
                    self.file.write(p.tobytes())
                self.parts = []
            return
        self.file.seek((self.n - len(values)) * self.dtype.itemsize)
        self.file.write(np.ascontiguousarray(values, dtype=self.dtype).tobytes())

    def part(self, at: int, to: int) -> np.ndarray:
        if self.file is None:
            return self.mapped()[at:to]
        self.file.seek(at * self.dtype.itemsize)
        return np.frombuffer(self.file.read((to - at) * self.dtype.itemsize), dtype=self.dtype)

    def mapped(self) -> np.ndarray:
        """The whole array, writable in place; nothing may be added afterwards but by :meth:`add`."""
        if self.file is None:
            if len(self.parts) != 1:
                self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=self.dtype)]
            return self.parts[0]
        self.file.flush()
        return np.memmap(self.file, dtype=self.dtype, mode="r+", shape=(self.n,))


def places(n: int) -> type:
    """Type that holds positions of a text of ``n`` characters."""
    return np.int32 if n < 1 << 31 else np.int64


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order; a narrow range of keys sorts by counting."""
    low = int(keys.min())
    return np.argsort((keys - low).astype(np.uint16) if int(keys.max()) - low < 1 << 16 else keys, kind="stable")


class Queue:
    """Priority queue of suffix tuples on disk: least character first, then first in, first out.

    Tuples wait in memory by character; past ``limit`` of them all are written as
    one run, ordered by character. A character's tuples are then read from the runs in the
    order they were written, and from memory last.
    """

    def __init__(self, limit: int):
        self.limit, self.held = max(limit, 1), 0
        self.parts: dict[int, list] = {}
        self.runs: list[tuple[Store, Store, dict[int, list[int]]]] = []
        self.heap: list[int] = []
        self.known: set[int] = set()

    def push(self, keys: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(keys):
            return
        order = _order(keys)
        keys, pos, lcp = keys[order], pos[order], lcp[order]
        at = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = [0, *at.tolist()], [*at.tolist(), len(keys)]
        for k, a, b in zip(keys[starts].tolist(), starts, ends, strict=True):
            if k not in self.known:
                self.known.add(k)
                heapq.heappush(self.heap, k)
            self.parts.setdefault(k, []).append((pos[a:b], lcp[a:b]))
        self.held += len(pos)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        where, pos, lcp = {}, Store(np.int64, 0), Store(np.uint8, 0)
        for k in sorted(self.parts):
            at = pos.n
            for p, c in self.parts[k]:
                pos.add(p)
                lcp.add(c)
            where[k] = [at, pos.n]
        self.runs.append((pos, lcp, where))
        self.parts, self.held = {}, 0

    def least(self) -> int | None:
        return self.heap[0] if self.heap else None

    def pop(self, key: int, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of ``key``; None once it has no more (it may be pushed again later)."""
        for pos, lcp, where in self.runs:
            if key in where:
                at, end = where[key]
                to = min(end, at + most)
                if to == end:
                    del where[key]
                else:
                    where[key][0] = to
                return pos.part(at, to), lcp.part(at, to)
        waiting = self.parts.get(key)
        if not waiting:
            if key in self.known:
                self.known.discard(key)
                self.heap.remove(key) if self.heap[0] != key else heapq.heappop(self.heap)
            return None
        taken, n = [], 0
        while waiting and n < most:
            p, c = waiting.pop(0)
            if n + len(p) > most:
                waiting.insert(0, (p[most - n :], c[most - n :]))
                p, c = p[: most - n], c[: most - n]
            taken.append((p, c))
            n += len(p)
        if not waiting:
            del self.parts[key]
        self.held -= n
        return (taken[0] if len(taken) == 1 else tuple(np.concatenate(x) for x in zip(*taken, strict=True)))


def common_prefix(text: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, bound) -> np.ndarray:
    """Length of the common prefix of ``text[a:]`` and ``text[b:]``, ``bound`` (a number, or one a pair) at most."""
    out = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(bound, n - np.maximum(a, b))
    open_ = np.flatnonzero(most > 0)
    if text.dtype == np.uint8 and n >= 8:  # eight bytes a step while both sides have them
        words = np.ndarray((n - 7,), dtype="<u8", buffer=text, strides=(1,))
        wide = open_[np.maximum(a[open_], b[open_]) + 8 <= n]
        rest = [np.setdiff1d(open_, wide, assume_unique=True)]
        while len(wide):
            off = out[wide]
            differ = words[a[wide] + off] ^ words[b[wide] + off]
            low = differ & (~differ + np.uint64(1))
            got = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            out[wide] = off + got
            wide = wide[(got == 8) & (off + 8 < most[wide])]
            fits = np.maximum(a[wide], b[wide]) + out[wide] + 8 <= n
            rest.append(wide[~fits])
            wide = wide[fits]
        open_ = np.concatenate(rest)
    while len(open_):
        open_ = open_[out[open_] < most[open_]]
        same = text[a[open_] + out[open_]] == text[b[open_] + out[open_]]
        open_ = open_[same]
        out[open_] += 1
    return np.minimum(out, most)


class _Least:
    """Least values over ranges of a short array, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (1 << (len(self.levels) - 1)):
            v, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of ``values[a:b]``, every range with one value at least."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=self.levels[0].dtype)
        for level in np.unique(k).tolist():
            sel = k == level
            v = self.levels[level]
            out[sel] = np.minimum(v[a[sel]], v[b[sel] - (1 << level)])
        return out


class _Carry:
    """Common prefixes of left neighbours put under one character: least value since the last of that character."""

    def __init__(self, bound: int):
        self.bound = bound
        self.low = np.full(256, -1, dtype=np.int64)

    def step(self, lcp: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Of the tuples just taken (``lcp`` each with its predecessor), those at ``at`` put neighbours under ``keys``."""
        whole = int(lcp.min())
        if not len(at):
            self.low = np.minimum(self.low, whole)
            return np.zeros(0, dtype=np.uint8)
        order = _order(keys)
        k, a = keys[order], at[order]
        fresh = np.concatenate([[True], k[1:] != k[:-1]])
        least = _Least(lcp)
        begin = np.where(fresh, 0, np.concatenate([[0], a[:-1] + 1]))
        got = least.over(begin, a + 1).astype(np.int64)
        got = np.where(fresh, np.minimum(got, self.low[k]), got)
        self.low = np.minimum(self.low, whole)
        last = np.concatenate([fresh[1:], [True]])
        tail = np.full(last.sum(), self.bound, dtype=np.int64)
        more = a[last] + 1 < len(lcp)
        tail[more] = least.over(a[last][more] + 1, np.full(more.sum(), len(lcp)))
        self.low[k[last]] = tail
        out = np.empty(len(at), dtype=np.uint8)
        out[order] = np.minimum(got + 1, self.bound)
        return out


def _empty() -> np.ndarray:
    return np.zeros(0, dtype=np.uint8)


def _induce(text, n: int, seeds: Iterator, bound: int, limit: int, stars_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes (or the leftmost-S ones) from the last to the first, each with the common prefix with the one before it.

    ``seeds`` gives chunks ``(character, positions, common prefixes)`` of the
    leftmost-S suffixes in order. ``bound`` 0 carries no common prefixes.
    """

    def meet(a: int, b: int) -> int:
        return int(common_prefix(text, n, np.array([a]), np.array([b]), bound)[0]) if bound else 0

    def sweep(queue, up: bool, char: int, pos, lcp, strict: bool, carry) -> None:
        left = pos - 1
        c = text[np.maximum(left, 0)].astype(np.int64)
        own = ((c > char) if strict else (c >= char)) if up else ((c < char) if strict else (c <= char))
        at = np.flatnonzero(own & (pos > 0))
        queue.push(c[at] if up else -c[at], left[at], carry.step(lcp, at, c[at]) if carry else np.zeros(len(at), dtype=np.uint8))

    queue, carry = Queue(limit), _Carry(bound) if bound else None
    falling, falling_lcp, chars = Store(places(n)), Store(np.uint8), []  # L suffixes in order
    queue.push(text[n - 1 : n].astype(np.int64), np.array([n - 1]), np.zeros(1, dtype=np.uint8))
    if carry:
        carry.low[text[n - 1]] = 0  # the end of the text, before all suffixes, put it there
    seed = next(seeds, None)
    while queue.least() is not None or seed is not None:
        char = min(x for x in (queue.least(), seed[0] if seed else None) if x is not None)
        last, before = None, falling.n
        while (got := queue.pop(char)) is not None:
            pos, lcp = got
            falling.add(pos)
            falling_lcp.add(lcp)
            last = int(pos[-1])
            sweep(queue, True, char, pos, lcp, False, carry)
        if falling.n > before:
            chars.append((char, before, falling.n))
        while seed is not None and seed[0] == char:
            _, pos, lcp = seed
            if carry and last is not None:
                lcp[0] = meet(last, int(pos[0]))
                last = None
            sweep(queue, True, char, pos, lcp, True, carry)
            seed = next(seeds, None)

    queue, carry = Queue(limit), _Carry(bound) if bound else None
    while queue.least() is not None or chars:
        char = max(x for x in (-queue.least() if queue.least() is not None else None, chars[-1][0] if chars else None) if x is not None)
        last = None
        while (got := queue.pop(-char)) is not None:
            pos, lcp = got
            last = int(pos[-1])
            sweep(queue, False, char, pos, lcp, False, carry)
            if stars_only:
                keep = (pos > 0) & (text[np.maximum(pos - 1, 0)] > char)
                pos, lcp = pos[keep], lcp[keep]
            if len(pos):
                yield pos, lcp
        if chars and chars[-1][0] == char:
            _, begin, end = chars.pop()
            for to in range(end, begin, -CHUNK):
                at = max(begin, to - CHUNK)
                pos = falling.part(at, to)[::-1]
                lcp = np.zeros(to - at, dtype=np.uint8)
                if bound:  # a value belongs to the pair with the next smaller suffix
                    lcp[1:] = falling_lcp.part(at + 1, to)[::-1]
                    lcp[0] = falling_lcp.part(to, to + 1)[0] if to < end else (meet(last, int(pos[0])) if last is not None else 0)
                sweep(queue, False, char, pos, lcp, True, carry)
                if not stars_only:
                    yield pos, lcp


def _stars(text, n: int) -> Store:
    """Positions of the leftmost-S suffixes, in text order."""
    cuts = list(range(0, n, CHUNK * 4))
    rising = {len(cuts): False}  # type of the suffix where the next block begins; the last one falls

    def types(k: int):
        a, b = cuts[k], min(cuts[k] + CHUNK * 4, n)
        here = np.asarray(text[a : min(b + 1, n)]).astype(np.int64)
        d = np.sign(here[1:] - here[:-1]) if b < n else np.append(np.sign(here[1:] - here[:-1]), -1)
        nxt = np.where(d != 0, np.arange(b - a), b - a)
        nxt = np.minimum.accumulate(nxt[::-1])[::-1]
        up = np.append(d > 0, rising[k + 1])
        return a, here, up[nxt]

    for k in range(len(cuts) - 1, -1, -1):
        rising[k] = bool(types(k)[2][0])
    out, left = Store(places(n)), False
    for k in range(len(cuts)):
        a, here, up = types(k)
        out.add(np.flatnonzero(up & ~np.concatenate([[True if a == 0 else left], up[:-1]])) + a)
        left = bool(up[-1])
    return out


def _doubled(names: np.ndarray, deep: int) -> np.ndarray:
    """Order of the suffixes of a short string of names, by prefix doubling (``deep`` names are enough).

    A rank is the first place of its group, so only groups that are still tied are sorted again.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    places = np.arange(n)
    key, tied, width = names[order], order, 1
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = places[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        rank[tied] = first
        lone = fresh & np.append(fresh[1:], True)
        tied, places, first = tied[~lone], places[~lone], first[~lone]
        if not len(tied) or width >= deep:
            return order
        nxt = np.where(tied + width < n, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        key = first * (n + 1) + nxt
        turn = np.argsort(key, kind="stable")
        tied, key = tied[turn], key[turn]
        order[places] = tied
        width *= 2


def _sorted_stars(text, n: int, stars: Store, deep: int, memory: int) -> tuple[Store, bool]:
    """The leftmost-S positions in suffix order; the flag says that they stand from last to first."""
    limit = memory // 32
    where = stars.mapped()
    m = stars.n
    queue = Queue(limit)
    for at in range(0, m, CHUNK):
        p = np.asarray(where[at : at + CHUNK])
        queue.push(text[p].astype(np.int64), p, np.zeros(len(p), dtype=np.uint8))

    def by_first() -> Iterator:
        while (char := queue.least()) is not None:
            while (got := queue.pop(char)) is not None:
                yield char, *got

    falling, number = Store(places(n)), Store(places(m))
    for at in range(0, m, CHUNK):
        number.add(np.zeros(min(CHUNK, m - at), dtype=number.dtype))
    names, count, before = number.mapped(), 0, None
    for pos, _ in _induce(text, n, by_first(), 0, limit, True):
        j = np.searchsorted(where, pos)
        ends = np.where(j + 1 < m, where[np.minimum(j + 1, m - 1)], n)
        held = (np.append(before[0], pos), np.append(before[1], ends)) if before else (pos, ends)
        a, b, size = held[0][:-1], held[0][1:], held[1] - held[0]
        same = np.zeros(len(a), dtype=bool)
        even = np.flatnonzero((size[1:] == size[:-1]) & (held[1][1:] < n) & (held[1][:-1] < n))
        for part in np.split(even, range(0, len(even), CHUNK)[1:]):
            if len(part):
                full = size[part] + 1
                same[part] = common_prefix(text, n, a[part], b[part], full) >= full
        new = np.cumsum(~same) if before else np.concatenate([[1], 1 + np.cumsum(~same)])
        names[j] = -(count + new)
        count += int(new[-1]) if len(new) else 0
        before = (held[0][-1:], held[1][-1:])
        falling.add(pos)
    if count == m:
        return falling, True
    for at in range(0, m, CHUNK):
        names[at : at + CHUNK] += count
    out = Store(places(n))
    if m * 64 <= memory:
        out.add(np.asarray(where)[_doubled(np.asarray(names), deep)])
        return out, False
    back = Store(places(n))
    for pos, _ in suffixes(names, m, 0, memory, deep):
        back.add(np.asarray(where[pos]))
    return back, True


def suffixes(text: np.ndarray, n: int, bound: int, memory: int, deep: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of ``text[:n]`` from the last suffix to the first, in chunks, each with the length of the
    common prefix with the suffix just before it in this order (``bound`` at most).

    Suffixes that agree in ``max(bound, 2 * deep)`` characters or more may stand in any order among themselves.
    """
    if n == 0:
        return
    deep = deep or max(1, bound)
    stars = _stars(text, n)
    if stars.n == 0:
        yield from _induce(text, n, iter(()), bound, memory // 32, False)
        return
    found, turned = _sorted_stars(text, n, stars, deep, memory)

    def in_order() -> Iterator:
        before = None
        for at in range(0, found.n, CHUNK):
            to = min(found.n, at + CHUNK)
            p = found.part(found.n - to, found.n - at)[::-1] if turned else found.part(at, to)
            lcp = np.zeros(len(p), dtype=np.uint8)
            if bound:
                pair = np.append(before, p) if before is not None else p
                lcp[len(p) - len(pair) + 1 :] = common_prefix(text, n, pair[:-1], pair[1:], bound)
            c = text[p].astype(np.int64)
            cut = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for a, b in zip(cut, cut[1:], strict=False):
                yield int(c[a]), p[a:b], lcp[a:b].copy()
            before = p[-1:]

    yield from _induce(text, n, in_order(), bound, memory // 32, False)
