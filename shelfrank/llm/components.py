"""Connected components of an edge table, by contraction inside tasks and stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written


def union_find(pairs) -> dict[int, int]:
    """Node -> smallest node joined with it through ``pairs``."""
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

    found = [(x, r) for x, r in union_find(pairs()).items() if x != r]
    cols = list(zip(*found, strict=True)) or [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the smallest id reachable, for nodes with edges ``a, b`` (longs);
    a component's smallest node itself has no row.

    In a round every task first joins the nodes of its own edges, so a node has
    at most one parent a task. Then a node keeps its smallest parent, hands its
    other parents to that one, and moves up to its parent's parent. One write a
    round cuts the lineage and says what is left to do: it is done when each node
    has one parent that has none itself. Nulls and loops are dropped; an empty
    table gives an empty result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    while True:
        forest = python_ready(e).mapInArrow(_contract, "a long, b long")
        up = forest.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("all"))  # at most one a task
        above = up.select(F.col("a").alias("u_a"), F.get("all", F.lit(0)).alias("u_m"))
        up = up.withColumn("m", F.get("all", F.lit(0)))
        rows = up.join(above, F.col("m") == F.col("u_a"), "left").select(
            "a", F.coalesce("u_m", "m").alias("b"), F.col("m").alias("top"), F.slice("all", 2, F.size("all")).alias("other"), F.col("u_a").isNotNull().alias("moved")
        )
        rows = written(rows, "components")
        if rows.where("moved or size(other) > 0").isEmpty():
            break
        handed = rows.select(F.explode("other").alias("a"), F.col("top").alias("b"))
        e = rows.select("a", "b").unionByName(handed)
    return rows.select(F.col("a").alias("node"), F.col("b").alias("comp"))
