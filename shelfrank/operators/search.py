"""Exact top-k search of a whole catalog for many queries.

Plan (no nested-loop join, nothing broadcast):

1. The larger side is dealt once to cells, by a hash of its key; every row of
   the smaller side is copied to every cell. Which side is smaller and how many cells there
   are is computed **inside the plan** from counts (scalar subqueries). So the larger side is
   shuffled once, whatever the parallelism.
2. A task reads a cell's dealt rows first and keeps them; the copied rows stream by in
   Arrow batches, so memory is bounded by the cell's size. Products stand in an index of
   blocks with a bound per vector slot (:mod:`shelfrank.operators.slot_index`):
   a query scores only blocks whose bound reaches its k-th best score so far.
3. A final ``row_number() <= k`` per query (WindowGroupLimit) merges the lists of the cells: exact,
   because each is a prefix of its cell's total order (score desc, NaN last, key asc).

Scores: dot products (normalized encoders) or cosines from raw vectors and
their squared norms — the same IEEE operations as the row-wise expression
path, so with integer count vectors the results are exact.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.text import _blank
from shelfrank.operators.ranking import top_k
from shelfrank.operators.slot_index import SlotIndex
from shelfrank.session import default_parallelism, ship_package

# Rows of a cell at most: a task keeps one cell's rows of the larger side (vectors of
# dim 64 take 1 KB a product in the index). Lower them for much larger dimensions.
DEFAULT_QUERY_BLOCK_ROWS = 65_536
DEFAULT_CATALOG_BLOCK_ROWS = 131_072
# Small inputs are dealt to one cell a task slot, as long as a cell has so many rows.
LEAST_CATALOG_ROWS, LEAST_QUERY_ROWS = 1024, 64


def _cells(n: Column, most: int, least: int, slots: int) -> Column:
    """Cells for ``n`` rows: ``most`` rows each at most, and one a task slot if each has ``least`` rows."""
    up = lambda rows: F.ceil(n / F.lit(float(rows)))
    return F.greatest(F.lit(1), up(most), F.least(F.lit(slots), up(least))).cast("int")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; a null vector (or one with a null entry) is a row of NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) == dim * len(column):
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    rows = column.to_pylist()
    if any(v is not None and len(v) != dim for v in rows):
        raise ValueError("vectors of different lengths")
    return np.array([[np.nan] * dim if v is None else [np.nan if x is None else x for x in v] for v in rows], dtype=np.float64).reshape(len(rows), dim)


def _key_codes(keys: pa.Array) -> np.ndarray:
    """Place of each key in key order (a null key comes first)."""
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


class _Cell:
    """One cell: its dealt rows, then the copied rows that stream by."""

    def __init__(self, k: int, cosine: bool):
        self.k, self.cosine, self.kept, self.index, self.floors = k, cosine, [], None, None

    def keep(self, part: pa.Table) -> None:
        self.kept.append(part)

    def _index(self, part: pa.Table, dim: int) -> SlotIndex:
        squares = part.column("sq").to_numpy().astype(np.float64) if self.cosine else None
        return SlotIndex(_matrix(part.column("vec"), dim), _key_codes(part.column("pk").combine_chunks()), squares)

    def _dim(self, *parts: pa.Table) -> int:
        return max((len(v) for p in parts for v in p.column("vec") if v.is_valid), default=0)

    def _hits(self, queries: pa.Table, vectors: np.ndarray, index: SlotIndex, products: pa.Table) -> Iterator[pa.RecordBatch]:
        squares = queries.column("sq").to_numpy().astype(np.float64) if self.cosine else np.zeros(len(vectors))
        parts = []
        for at in range(0, len(vectors), QUERIES):
            sl = slice(at, at + QUERIES)
            i, rows, scores = index.top(vectors[sl], squares[sl], self.k, None if self.floors is None else self.floors[sl, 0])
            if self.floors is not None:  # the best k scores of each query so far, rising; the first is the k-th
                real = ~np.isnan(scores)
                width = np.bincount(i[real], minlength=len(vectors[sl]))
                new = np.full((len(width), self.k), -np.inf)
                new[i[real], np.arange(real.sum()) - np.repeat(np.cumsum(width) - width, width)] = scores[real]
                self.floors[sl] = np.sort(np.concatenate([self.floors[sl], new], axis=1), axis=1)[:, -self.k :]
            parts.append((i + at, rows, scores))
        q_at, p_at, found = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
        for at in range(0, len(q_at), OUT_ROWS):
            sl = slice(at, at + OUT_ROWS)
            cols = queries.column("qk").take(pa.array(q_at[sl])), products.column("pk").take(pa.array(p_at[sl])), pa.array(found[sl].astype(np.float64))
            yield from pa.table(list(cols), names=["qk", "pk", "score"]).to_batches()

    def stream(self, part: pa.Table, queries_stream: bool) -> Iterator[pa.RecordBatch]:
        if not self.kept:
            return
        if queries_stream:  # the cell's products stay, queries come by
            if self.index is None:
                self.products = pa.concat_tables(self.kept)
                self.dim = self._dim(self.products.slice(0, 64)) or self._dim(self.products) or self._dim(part)
                self.index = self._index(self.products, self.dim)
            yield from self._hits(part, _matrix(part.column("vec"), self.dim), self.index, self.products)
        else:  # the cell's queries stay, products come by; a query's k-th best score rises from batch to batch
            if self.floors is None:
                self.queries = pa.concat_tables(self.kept)
                self.floors = np.full((len(self.queries), self.k), -np.inf)
            dim = self._dim(self.queries) or self._dim(part)
            yield from self._hits(self.queries, _matrix(self.queries.column("vec"), dim), self._index(part, dim), part)


# Rows of a result batch, and queries that are held against an index at once.
OUT_ROWS, QUERIES = 100_000, 128


def _search_cells(k: int, cosine: bool) -> Callable:
    """Task function over rows sorted by ``cell, ord`` (ord 0: dealt rows, 1: copied rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            where, ords, asked = (t.column(c).to_numpy() for c in ("cell", "ord", "is_query"))
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(ords) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                if lo == hi:
                    continue
                if where[lo] != at:
                    at, cell = where[lo], _Cell(k, cosine)
                part = t.slice(lo, hi - lo)
                if ords[lo] == 0:
                    cell.keep(part)
                else:
                    yield from cell.stream(part, bool(asked[lo]))

    return run


def deal(q: DataFrame, p: DataFrame, slots: int, query_block_rows: int, catalog_block_rows: int) -> DataFrame:
    """Rows of queries (``qk, vec, sq``) and products (``pk, vec, sq``) with their ``cell``: the larger
    side once (``ord`` 0), the smaller one once a cell (``ord`` 1)."""
    n_q, n_p = (x.select(F.count(F.lit(1)).alias("n")).scalar() for x in (q, p))
    copied = n_q <= n_p
    cells = F.when(copied, _cells(n_p, catalog_block_rows, LEAST_CATALOG_ROWS, slots)).otherwise(_cells(n_q, query_block_rows, LEAST_QUERY_ROWS, slots))

    def placed(side: DataFrame, key: str, copy: Column) -> DataFrame:
        one = F.pmod(F.xxhash64(key), cells).cast("int")
        where = F.explode(F.when(copy, F.sequence(F.lit(0), cells - 1)).otherwise(F.array(one)))
        return side.select("*", where.alias("cell"), copy.cast("int").alias("ord"), F.lit(key == "qk").alias("is_query"))

    all_q = q.withColumn("pk", F.lit(None).cast(p.schema["pk"].dataType))
    all_p = p.withColumn("qk", F.lit(None).cast(q.schema["qk"].dataType))
    return placed(all_q, "qk", copied).unionByName(placed(all_p, "pk", ~copied))


def catalog_topk(
    queries: DataFrame,
    catalog: DataFrame,
    k: int,
    query_key: str = "query",
    product_key: str = "product_id",
    q_vec: str = "q_emb",
    p_vec: str = "p_emb",
    normalized: bool = True,
    q_sq: str = "q_sq",
    p_sq: str = "p_sq",
    query_block_rows: int = DEFAULT_QUERY_BLOCK_ROWS,
    catalog_block_rows: int = DEFAULT_CATALOG_BLOCK_ROWS,
) -> DataFrame:
    """Top ``k`` products of the whole catalog per query.

    ``queries``: one row per query (``query_key``, vector[, squared norm]);
    ``catalog``: one row per product (``product_key``, vector[, squared norm]).
    Returns ``query_key, product_key, score, rank`` (rank 1..k; fewer rows when
    the catalog is smaller than k). Null vectors rank last.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = queries.sparkSession
    ship_package(spark)
    slots = default_parallelism(spark)
    square = lambda c: F.lit(0.0) if normalized else F.col(c).cast("double")
    entry = {queries.schema[q_vec].dataType.elementType.simpleString(), catalog.schema[p_vec].dataType.elementType.simpleString()}
    kind = f"array<{entry.pop() if len(entry) == 1 else 'double'}>"
    q = queries.select(F.col(query_key).alias("qk"), F.col(q_vec).cast(kind).alias("vec"), square(q_sq).alias("sq"))
    p = catalog.select(F.col(product_key).alias("pk"), F.col(p_vec).cast(kind).alias("vec"), square(p_sq).alias("sq"))
    rows = deal(q, p, slots, query_block_rows, catalog_block_rows)
    n = max(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionById(n, F.pmod(F.col("cell"), F.lit(n))) if hasattr(rows, "repartitionById") else rows.repartition(n, "cell")
    out = T.StructType([q.schema["qk"], p.schema["pk"], T.StructField("score", T.DoubleType())])
    found = dealt.sortWithinPartitions("cell", "ord").mapInArrow(_search_cells(k, not normalized), out)
    return top_k(found.withColumnsRenamed({"qk": query_key, "pk": product_key}), query_key, "score", product_key, k, "rank")


def safe_catalog(catalog: DataFrame, blocked: str = "blocked") -> DataFrame:
    """G3 filter: drop blocked products — unless every product is blocked, in
    which case the whole catalog is kept (the unfiltered fallback). The
    all-blocked fact is a scalar subquery over the catalog."""
    n_allowed = catalog.select(F.count_if(~F.col(blocked)).alias("n")).scalar()
    return catalog.where(~F.col(blocked) | (n_allowed == 0))


# --- A11: text form of a hit list ------------------------------------------------

# --- fixed values: lines of a search result text (format templates) -------------
REPORT_QUERY_LINE = "Query: {query}\n"
REPORT_MODEL_LINE = "Model: {model}\n"
REPORT_TOP_LINE = "Top {n} results:\n\n"
REPORT_TOP_LINE_SAFE = "Top {n} results\n"
REPORT_BLOCKED_TEXT_LINE = "Blocked text keywords: {keywords}\n"
REPORT_BLOCKED_TYPE_LINE = "Blocked type keywords: {keywords}\n\n"
HIT_RANK_LINE = "#{rank} (score={score:.4f})\n"
HIT_NAME_BRAND_LINE = "  Name: {name} [{brand}]\n"
HIT_NAME_LINE = "  Name: {name}\n"
HIT_TYPE_LINE = "  Type: {ptype} | Group: {group}\n"
HIT_TEXT_LINE = "  Text: {text}\n\n"
# Keyword lists print as Python list literals, e.g. ['anvil', 'bolt'].
# ---------------------------------------------------------------------------------


def _template_parts(template: str):
    """(literal, field, format spec) pieces of a format template."""
    return [(lit, field, spec) for lit, field, spec, _ in string.Formatter().parse(template)]


def template_col(template: str, fields: dict) -> Column:
    """A format template as one ``concat`` of literals and columns; a field
    with a ``.Nf`` spec is formatted with ``format_string``."""
    parts = []
    for lit, field, spec in _template_parts(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            c = fields[field]
            parts.append(F.format_string(f"%{spec}", c) if spec else c.cast("string"))
    return F.concat(*parts)


def keyword_list_text(items: Sequence[str]) -> str:
    return repr(list(items))


def search_report(
    hits: DataFrame,
    query: str = "query",
    model: str = "model",
    safe: bool = False,
    text_keywords: Sequence[str] = (),
    type_keywords: Sequence[str] = (),
) -> DataFrame:
    """One text per (model, query) from ranked hits.

    ``hits`` columns: model, query, rank, score, product_text, ProductName,
    BrandName and (safe form) ProductType, Level4_ProductGroup. A null name
    falls back to the text; a null brand/type/group counts as empty. Each
    query has at most k hits, so the per-query collect is bounded by k.
    """
    name = F.coalesce(F.col("ProductName"), F.col("product_text"))
    brand = _blank("BrandName")
    line = F.concat(
        template_col(HIT_RANK_LINE, {"rank": F.col("rank"), "score": F.col("score")}),
        F.when(brand != "", template_col(HIT_NAME_BRAND_LINE, {"name": name, "brand": brand})).otherwise(
            template_col(HIT_NAME_LINE, {"name": name})
        ),
    )
    if safe:
        ptype, group = _blank("ProductType"), _blank("Level4_ProductGroup")
        type_line = template_col(HIT_TYPE_LINE, {"ptype": ptype, "group": group})
        line = F.concat(line, F.when((ptype != "") | (group != ""), type_line).otherwise(F.lit("")))
    line = F.concat(line, template_col(HIT_TEXT_LINE, {"text": _blank("product_text")}))
    g = hits.groupBy(model, query).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line")))).alias("_l"),
    )
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "")
    head = [
        template_col(REPORT_QUERY_LINE, {"query": F.col(query)}),
        template_col(REPORT_MODEL_LINE, {"model": F.col(model)}),
    ]
    if safe:
        head += [
            template_col(REPORT_TOP_LINE_SAFE, {"n": F.col("n_hits")}),
            template_col(REPORT_BLOCKED_TEXT_LINE, {"keywords": F.lit(keyword_list_text(text_keywords))}),
            template_col(REPORT_BLOCKED_TYPE_LINE, {"keywords": F.lit(keyword_list_text(type_keywords))}),
        ]
    else:
        head.append(template_col(REPORT_TOP_LINE, {"n": F.col("n_hits")}))
    return g.select(model, query, "n_hits", F.concat(*head, body).alias("report"))
