"""Operator 4: near-copies of embeddings by an inverted multi-index.

Unit vectors are cut in halves; a codebook on each half, fitted on a bounded
sample, makes a product grid of cells. Every vector is a member of its home
cell. It also visits other cells in the order of the summed distances of both
halves (multi-sequence order) until the target recall: a cell is visited while
its sum exceeds the home cell's by no more than a margin, which is the quantile,
at the target recall, over neighbours at the lowest similarity that links.

Of two vectors with different home cells the one with the lower cell visits the
other, so each pair is compared in one place. Large cells are cut into blocks
and block pairs are compared apart from each other; a task gives out sums and a
forest, never pairs. All candidates are verified with exact cosines. Equal
vectors are one class and are counted, not compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written
from shelfrank.llm.components import components, union_find

#: Vectors that the codebooks and the margin are fitted on, at most.
SAMPLE_ROWS = 16_384
#: Codes of a half, at most, and vectors that a grid cell holds in the mean below that.
MOST_CODES, CELL_ROWS = 256, 256
#: Members or visitors of a cell that are compared at once.
BLOCK_ROWS = 512
STEPS = 8

_SIDES = "lab string, dim int, cell int, visitor boolean, cid long"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so large numbers don't overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_codes(half: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Codebook of one half by k-means; the first codes are rows of the sample."""
    codes = half[rng.permutation(len(half))[:k]].copy()
    for _ in range(STEPS):
        near = excess(half, codes).argmin(axis=1)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, half)
        n = np.bincount(near, minlength=len(codes))[:, None]
        codes = np.where(n > 0, sums / np.maximum(n, 1), codes)
    return codes


def excess(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each code, above the row's least."""
    d = (codes * codes).sum(axis=1) - 2 * half @ codes.T
    return d - d.min(axis=1, keepdims=True)


class MultiIndex:
    """Two codebooks and the margin up to which cells are visited."""

    def __init__(self, sample: np.ndarray, rows: int, *, least: float, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.cut = (self.dim + 1) // 2
        k = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, min(MOST_CODES, len(sample))))
        self.codes = [fit_codes(h, k, rng) for h in self.halves(sample)]
        self.k = [len(c) for c in self.codes]
        # neighbours at the lowest similarity that links, in random directions
        z = rng.normal(size=sample.shape)
        z -= (z * sample).sum(axis=1, keepdims=True) * sample
        z /= np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-300)
        near = least * sample + np.sqrt(max(0.0, 1 - least * least)) * z
        over = np.zeros(len(sample))
        for h, g, c in zip(self.halves(sample), self.halves(near), self.codes, strict=True):
            over += excess(h, c)[np.arange(len(sample)), excess(g, c).argmin(axis=1)]
        self.margin = float(np.quantile(over, recall, method="higher"))

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.cut], v[:, self.cut :]

    def home(self, v: np.ndarray) -> np.ndarray:
        a, b = (excess(h, c).argmin(axis=1) for h, c in zip(self.halves(v), self.codes, strict=True))
        return a * self.k[1] + b

    def visits(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Homes, and (row, cell) of the visited cells, nearest cells first for each row."""
        e, f = (excess(h, c) for h, c in zip(self.halves(v), self.codes, strict=True))
        home = e.argmin(axis=1) * self.k[1] + f.argmin(axis=1)
        row, i = np.nonzero(e <= self.margin)
        # the second half's codes in order of distance; a row takes as many as its rest allows
        by_distance = np.argsort(f, axis=1, kind="stable")
        sorted_f = np.take_along_axis(f, by_distance, axis=1)
        rest = self.margin - e[row, i]
        many = (sorted_f[row] <= rest[:, None]).sum(axis=1)
        at = np.repeat(np.arange(len(row)), many)
        j = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        rows, first, second = row[at], i[at], by_distance[row[at], j]
        order = np.lexsort((e[rows, first] + f[rows, second], rows))
        return home, rows[order], (first * self.k[1] + second)[order]


def _matrix(raw: pa.Array, dim: int) -> np.ndarray:
    """Binary doubles as rows, filled up with zeros to ``dim`` (no cosine changes)."""
    out = np.zeros((len(raw), dim))
    for r, x in enumerate(raw):
        v = np.frombuffer(x.as_buffer(), np.float64)
        out[r, : len(v)] = v
    return out


def _to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their unit vectors."""
    for b in batches:
        units = [unit(np.array([x.as_py()], np.float64))[0].tobytes() for x in b.column(4)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(units, pa.binary())], names=["cid", "lab", "dim", "n", "u"])


def _sides(index: MultiIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            home, rows, cells = index.visits(_matrix(part.column(3), index.dim))
            ahead = cells > home[rows]  # one of two cells visits the other
            rows, cells = rows[ahead], cells[ahead]
            take = np.concatenate([np.arange(len(home)), rows])
            lab, dim, cid = (part.column(c).take(pa.array(take)) for c in (1, 2, 0))
            visitor = pa.array(np.arange(len(take)) >= len(home))
            yield pa.RecordBatch.from_arrays([lab, dim, pa.array(np.concatenate([home, cells]).astype(np.int32)), visitor, cid], names=["lab", "dim", "cell", "visitor", "cid"])


def _compare(least: float):
    def run(t: pa.Table) -> pa.Table:
        """One block pair: sums of links by class (kind 0) and a forest of links (kind 1)."""
        t = t.combine_chunks()
        cid, n = t["cid"].to_numpy(), t["n"].to_numpy()
        left, right = (np.flatnonzero(t[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        raw = t["u"].chunk(0) if t.num_rows else t["u"].combine_chunks()
        u = np.frombuffer(b"".join(x.as_py() for x in raw), np.float64).reshape(len(cid), -1)
        near = u[left] @ u[right].T >= least
        # the two sides of a diagonal block are the same members: each pair once
        near &= ~((cid[left][:, None] >= cid[right][None, :]) & t["own"].to_numpy(zero_copy_only=False)[right][None, :])
        sums = np.zeros(len(cid), np.int64)
        sums[left] += near @ n[right]
        sums[right] += n[left] @ near
        a, b = np.nonzero(near)
        forest = [(x, r) for x, r in union_find(zip(cid[left][a].tolist(), cid[right][b].tolist(), strict=True)).items() if x != r]
        has = np.flatnonzero(sums)
        x, y = zip(*forest, strict=True) if forest else ((), ())
        kind = np.concatenate([np.zeros(len(has), np.int32), np.ones(len(forest), np.int32)])
        return pa.table({"kind": kind, "a": pa.array([*cid[has].tolist(), *x], pa.int64()), "b": pa.array([*sums[has].tolist(), *y], pa.int64())})

    return run


def _blocks(sides: DataFrame, block_rows: int) -> DataFrame:
    """Each side's rows with the block pairs that they belong to.

    Members are cut into ``m`` parts and visitors into ``v``: a member part is
    the left side against itself, the member parts after it, and all visitors.
    """
    cell = ["lab", "dim", "cell"]
    counts = sides.groupBy(*cell).agg(F.sum(F.when(F.col("visitor"), 0).otherwise(1)).alias("m"), F.sum(F.col("visitor").cast("int")).alias("v")).where("m > 0 and m + v > 1")
    parts = counts.select(*cell, F.ceil(F.col("m") / block_rows).cast("int").alias("m"), F.ceil(F.col("v") / block_rows).cast("int").alias("v"))
    rows = sides.join(parts, cell).withColumn("p", F.pmod(F.xxhash64("cid"), F.when(F.col("visitor"), F.col("v")).otherwise(F.col("m"))).cast("int"))
    none = F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean,own:boolean>>")

    def pairs(lo, hi, of):
        return F.when(hi >= lo, F.transform(F.sequence(lo, hi), of)).otherwise(none)

    def at(i, j, left, right, own=False):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(own).alias("own"))

    p, m, v = F.col("p"), F.col("m"), F.col("v")
    member = F.concat(
        F.array(at(p, p, True, True, True)),
        pairs(p + 1, m + v - 1, lambda j: at(p, j, True, False)),
        pairs(F.lit(0), p - 1, lambda i: at(i, p, False, True)),
    )
    visitor = pairs(F.lit(0), m - 1, lambda i: at(i, m + p, False, True))
    return rows.select(*cell, "cid", F.explode(F.when(F.col("visitor"), visitor).otherwise(member)).alias("x")).select(*cell, "cid", "x.*")


def near_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    recall: float = 0.995,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 4,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows with a null label, or a vector that is null, empty, zero or holds null or
    non-finite numbers link with nothing; vectors of different lengths don't
    link. Rows that repeat an id are vectors of their own; a null id isn't a
    component's smallest, and a row that links with nothing has its own id. Ties
    don't arise: all links count. An empty table gives an empty result; extra
    columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    ok = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    slim = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).cast("string").alias("lab"), F.coalesce(ok, F.lit(False)).alias("ok"), v.alias("v"))
    # the seed comes first: Spark chains the columns, so after the vector it would make h2 a function of h1
    hashed = slim.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(seed), "v"))
    same = ["lab", "h1", "h2"]
    classes = hashed.where("ok").groupBy(*same).agg(F.min("k").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    dims = classes.select("cid", "lab", F.size("v").alias("dim"), "n", "v")
    units = written(python_ready(dims).mapInArrow(_to_bytes, "cid long, lab string, dim int, n long, u binary"), "vectors-units")

    n_rows, dim = units.agg(F.count("*"), F.max("dim")).first()
    if n_rows:
        share = min(1.0, 0.9 * sample_rows / n_rows) if n_rows > sample_rows else 1.0
        place = F.shiftrightunsigned(F.xxhash64("u", F.lit(seed)), 33)
        sample = units.where(place < int(share * (1 << 31))).select(place.alias("place"), "u").orderBy("place", "u").limit(sample_rows).toArrow()
        if not sample.num_rows:
            sample = units.select("u").limit(1).toArrow()
        index = MultiIndex(_matrix(sample["u"].combine_chunks(), dim), n_rows, least=least, recall=recall, seed=seed)
        # the codebooks, at most 2 x MOST_CODES half vectors, go with the function
        sides = written(units.select("cid", "lab", "dim", "u").mapInArrow(functools.partial(_sides, index), _SIDES), "vectors-sides")
        blocks = _blocks(sides, block_rows).join(units.select("cid", "n", "u"), "cid")
        found = python_ready(blocks).groupBy("lab", "dim", "cell", "i", "j").applyInArrow(_compare(least), "kind int, a long, b long")
        found = written(found, "vectors-found")
    else:
        found = spark.createDataFrame([], "kind int, a long, b long")

    links = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    comps = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    of_class = classes.select("cid", *same, "rep", "n").join(links, "cid", "left").join(comps, "cid", "left")
    of_class = written(of_class.withColumn("comp", F.coalesce("comp", "cid")), "vectors-linked")
    least_id = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    linked = of_class.join(least_id, "comp").select(*[F.col(c).alias(f"c_{c}") for c in same], (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    on = (F.col("lab") == F.col("c_lab")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2")) & F.col("ok")
    out = hashed.select("k", "ok", *same).join(linked, on, "left")
    component = F.when(F.coalesce("n_links", F.lit(0)) > 0, F.col("component_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"))
