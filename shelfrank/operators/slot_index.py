"""Exact top-k over blocks of similar vectors with bounds per vector slot.

Products are dealt to small blocks of similar vectors (split at the median of
the slot that varies most). For every slot the index has a list of the largest and
the smallest entry of each block, scaled to unit length. A batch of queries reads
these lists first; a block whose bound for a query lies below the query's k-th best score
so far is never scored for it. That score rises from round to round: first the blocks of best bounds
are scored, then the upper half of what may still count, then the rest.
"""

from __future__ import annotations

import numpy as np

#: Products of a block.
BLOCK = 4
#: Pairs of a query and a block that are scored at once.
PAIRS = 1 << 13
#: Bounds are computed in another order of sums than scores; this much of the bound's size is added to them.
SLACK = 1e-9


def _similar(unit: np.ndarray, size: int) -> np.ndarray:
    """Row numbers, so ordered that ``size`` in a row are alike."""
    out, todo = [], [np.arange(len(unit))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = unit[rows]
        order = np.argsort(part[:, int(part.var(axis=0).argmax())], kind="stable")
        half = -(-len(rows) // (2 * size)) * size  # whole blocks on the left
        todo += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class SlotIndex:
    """Products ``vectors`` (rows; NaN rows are null vectors) with key order ``codes``; ``squares`` for cosines."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, squares: np.ndarray | None = None, block: int = BLOCK):
        self.codes, self.block, self.cosine = codes, block, squares is not None
        usable = ~np.isnan(vectors).any(axis=1)
        norm = np.sqrt(np.where(usable, squares, 1.0)) if self.cosine else np.ones(len(vectors))
        unit = np.where((norm > 0)[:, None], vectors / np.where(norm > 0, norm, 1.0)[:, None], 0.0)
        good, lost = np.flatnonzero(usable), np.flatnonzero(~usable)
        good = good[_similar(unit[good], block)]
        self.blocks = -(-len(good) // block)
        pad = self.blocks * block - len(good)
        self.rows = np.concatenate([good, np.full(pad, -1)]).reshape(self.blocks, block)
        self.lost, self.all = lost[np.argsort(codes[lost], kind="stable")], np.argsort(codes, kind="stable")
        dim = vectors.shape[1]
        self.entries = np.concatenate([vectors[good], np.zeros((pad, dim))]).reshape(self.blocks, block, dim)
        self.norm = np.concatenate([norm[good], np.ones(pad)]).reshape(self.blocks, block)
        tops = np.concatenate([unit[good], np.repeat(unit[good[-1:]], pad, axis=0)]).reshape(self.blocks, block, dim)
        self.high, self.low = np.ascontiguousarray(tops.max(axis=1).T), np.ascontiguousarray(tops.min(axis=1).T)
        self.scored = 0

    def _bounds(self, w: np.ndarray) -> np.ndarray:
        up, down = np.maximum(w, 0), np.minimum(w, 0)
        size = np.abs(w).sum(axis=1, keepdims=True) * max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0))
        return up @ self.high + (down @ self.low if down.any() else 0) + SLACK * (1 + size)

    def _score(self, q: np.ndarray, length: np.ndarray, i: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, rows and scores of the pairs (query, block)."""
        out = []
        for at in range(0, len(i), PAIRS):
            qi, bi = i[at : at + PAIRS], b[at : at + PAIRS]
            s = np.einsum("mbd,md->mb", self.entries[bi], q[qi])
            if self.cosine:
                den = length[qi][:, None] * self.norm[bi]
                s = np.where(den > 0, s / np.where(den > 0, den, 1.0), 0.0)
            out.append((np.repeat(qi, self.block), self.rows[bi].ravel(), s.ravel()))
        self.scored += len(i) * self.block
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def _best(self, i: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``k`` of each query: score falling, smaller code first."""
        order = np.lexsort((self.codes[rows], -scores, i))
        i, rows, scores = i[order], rows[order], scores[order]
        start = np.searchsorted(i, i)
        keep = np.arange(len(i)) - start < k
        return i[keep], rows[keep], scores[keep]

    def top(self, q: np.ndarray, squares: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best ``k`` rows of each query of a batch: ``(query, row, score)``, best first within a query.

        ``floors``: k-th best scores already known from other products; lower scores are left out.
        """
        n = len(q)
        lost_q = np.isnan(q).any(axis=1)
        q = np.where(lost_q[:, None], 0.0, q)
        length = np.sqrt(np.where(lost_q, 1.0, squares)) if self.cosine else np.ones(n)
        kth = np.full(n, -np.inf) if floors is None else floors.astype(np.float64).copy()
        known = kth > -np.inf
        bound = self._bounds(np.where((length > 0)[:, None], q / np.where(length > 0, length, 1.0)[:, None], 0.0)) if self.blocks else np.zeros((n, 0))
        bound[lost_q] = -np.inf
        open_ = np.isfinite(bound)
        first = min(self.blocks, 1 + (2 * k) // self.block)
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for turn in range(3):
            if turn == 0:
                at = np.argpartition(-bound, first - 1, axis=1)[:, :first] if first < self.blocks else np.tile(np.arange(self.blocks), (n, 1))
                now = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(now, at, True, axis=1)
                now &= open_ & (bound >= kth[:, None])
            else:
                now = open_ & (bound >= kth[:, None])
                if turn == 1 and now.any():  # the better half of what may still count
                    top = np.where(now, bound, -np.inf).max(axis=1)
                    middle = np.where(np.isfinite(kth) & np.isfinite(top), (np.where(np.isfinite(kth), kth, 0) + np.where(np.isfinite(top), top, 0)) / 2, -np.inf)
                    now &= bound >= middle[:, None]
            open_ &= ~now
            i, rows, scores = self._score(q, length, *np.nonzero(now))
            ok = (rows >= 0) & (scores >= kth[i])
            found = self._best(*(np.append(x, y[ok]) for x, y in zip(found, (i, rows, scores), strict=True)), k)
            count = np.bincount(found[0], minlength=n)
            full = count >= k
            kth[full] = np.maximum(kth[full], found[2][np.cumsum(count)[full] - 1])
        short = np.flatnonzero((count < k) & ~known)  # null vectors come last; a null query scores NaN with all
        if len(short) and (len(self.lost) or lost_q.any()):
            extra = [(self.all if lost_q[x] else self.lost)[: k - count[x]] for x in short.tolist()]
            more = np.concatenate(extra)
            i = np.concatenate([found[0], np.repeat(short, [len(e) for e in extra])])
            order = np.argsort(i, kind="stable")
            found = i[order], np.append(found[1], more)[order], np.append(found[2], np.full(len(more), np.nan))[order]
        return found
