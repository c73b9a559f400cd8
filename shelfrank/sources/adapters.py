"""Adapters that derive the engine's input tables from the base tables.

``impressions``     (query, product, clicks) rows from lineitem/part/orders/customer
``judged_vec``      scored (query vector, candidate vector) pairs from ``embeddings``
``judge_responses`` raw judge answers of eleven forms from ``conversations``
``run_documents``   metrics documents of many runs from ``events``

Each is a Spark plan over the base tables, so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.session import default_parallelism, ship_package
from shelfrank.sources.tables import read_table

# --- fixed values of the impressions adapter ---------------------------------
LANGUAGES_BY_PARTKEY_MOD4 = ("de", "fr", "it", "en")  # p_partkey % 4 = 0, 1, 2, 3
NULL_QUERY_SIZE = 50  # p_size that gives a null query
NULL_BRAND = "Brand#13"  # brand that becomes null
NULL_GROUP_MOD = 7  # p_size % 7 = 0 -> null group
NULL_TYPE_MOD = 11  # p_size % 11 = 0 -> null type
SELECT_FLAG = "A"  # l_returnflag of a "selection"
SELECT_MIN_DISCOUNT = 0.055  # ... with l_discount above this
ANSWER_TURNS = 1000  # pair_id = conv_id * this + turn
# ---------------------------------------------------------------------------


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with ``product_id``; one row per (query, product) null-safely.

    Plan: orders⋈customer gives the segment per order; lineitem is reduced to
    (order, part, selected) and joined on the order key, then **aggregated on
    (part, segment) before** the part join, so the wide string columns are built
    once per group rather than once per line item. The last group-by merges
    the segments of parts whose query is null.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag", "l_discount"])
    li = li.select(
        "l_orderkey",
        "l_partkey",
        F.when((F.col("l_returnflag") == SELECT_FLAG) & (F.col("l_discount") > SELECT_MIN_DISCOUNT), 1)
        .otherwise(0)
        .alias("sel"),
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    order_seg = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "c_mktsegment")
    # lineitem⋈orders joins two fact tables that both grow with the data: a
    # sort-merge join at any scale (or a co-bucketed one). The hint keeps small
    # local files from being planned as a broadcast of the lineitem side, which
    # would probe the whole table in one task.
    per_part_seg = (
        li.hint("merge")
        .join(order_seg, li.l_orderkey == order_seg.o_orderkey)
        .groupBy("l_partkey", "c_mktsegment")
        .agg(F.sum("sel").alias("sel"))
    )
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    j = per_part_seg.join(part, per_part_seg.l_partkey == part.p_partkey)
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES_BY_PARTKEY_MOD4]), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = j.select(
        F.when(F.col("p_size") == NULL_QUERY_SIZE, F.lit(None).cast("string"))
        .otherwise(F.concat_ws(" ", F.lower("c_mktsegment"), F.col("p_name"), F.lower("p_type")))
        .alias("OriginalQuery"),
        lang.alias("PageLanguage"),
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("ProductName"),
        F.when(F.col("p_brand") == NULL_BRAND, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("BrandName"),
        F.when(F.col("p_size") % NULL_GROUP_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Group "), F.col("p_size").cast("string")))
        .alias("Level4_ProductGroup"),
        F.when(F.col("p_size") % NULL_TYPE_MOD == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("ProductType"),
        "sel",
    )
    keys = ["OriginalQuery", "PageLanguage", "product_id", "ProductName", "BrandName", "Level4_ProductGroup", "ProductType"]
    return rows.groupBy(*keys).agg(F.sum("sel").cast("bigint").alias("UniqueSelects"))


# (7·c + 13·q) ≡ 0 (mod 23)  ⇔  c ≡ 8·q (mod 23): the pairing rule as an equi-join key.
_PAIR_MOD = 23
_PAIR_MULT = 8


def judged_vec(spark: SparkSession, sf_dir: str, graded: bool = False, salts: int = 16) -> DataFrame:
    """Scored pairs: every 10th vector is a query; candidates pair by a modular rule.

    Columns: query_id, product_id, score (ordered double dot), relevant (0/1,
    or 0/1/2 when ``graded``). The rule is an equality of residues with only 23
    values, so candidates are salted into ``salts`` groups and the (smaller) query
    side is replicated once per salt: 23 × salts balanced cells. Rows meet in their
    cell; a task keeps a cell's candidates, its queries stream by in Arrow batches and
    are scored in blocks, so vectors are shuffled once and never copied for a pair.
    """
    ship_package(spark)
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    q = e.where(F.col("vec_id") % 10 == 0).select(
        "*",
        F.pmod(F.col("vec_id") * _PAIR_MULT, F.lit(_PAIR_MOD)).alias("jk"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.lit(True).alias("is_query"),
    )
    c = e.where(F.col("vec_id") % 10 != 0).select(
        "*",
        F.pmod(F.col("vec_id"), F.lit(_PAIR_MOD)).alias("jk"),
        F.pmod(F.xxhash64(F.col("vec_id")), F.lit(salts)).cast("int").alias("salt"),
        F.lit(False).alias("is_query"),
    )
    cell = (F.col("jk") * salts + F.col("salt")).cast("int").alias("cell")
    rows = q.unionByName(c).select(cell, "is_query", "vec_id", "embedding", "label")
    n = min(_PAIR_MOD * salts, max(3 * default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartitionById(n, F.pmod(F.col("cell"), F.lit(n))) if hasattr(rows, "repartitionById") else rows.repartition(n, "cell")
    dealt = dealt.sortWithinPartitions("cell", "is_query")
    return dealt.mapInArrow(_cell_pairs(graded), "query_id bigint, product_id bigint, score double, relevant int")


def _cell_pairs(graded: bool) -> Callable:
    """Task function over rows sorted by ``cell, is_query`` (candidates first): all pairs of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, block = None, [], None
        for b in batches:
            cells, asked = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((np.diff(cells) != 0) | (asked[1:] != asked[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if lo == hi:
                    continue
                if cells[lo] != at:
                    at, kept, block = cells[lo], [], None
                part = b.slice(lo, hi - lo)
                if not asked[lo]:
                    kept.append(part)
                elif kept:
                    block = block or _vectors(pa.Table.from_batches(kept).combine_chunks())
                    yield from _block_pairs(_vectors(pa.Table.from_batches([part])), block, graded)

    return run


# Pairs that are scored at once (a few MB of doubles).
_BLOCK_PAIRS = 1 << 17


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors as columns of doubles (short ones filled up with 0), their lengths (-1: null
    or with a null entry) and labels (null: NaN)."""
    vec = rows.column("embedding").combine_chunks()
    vec = pa.concat_arrays(vec.chunks) if isinstance(vec, pa.ChunkedArray) else vec
    flat = vec.flatten()
    lengths = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(vec)), lengths)
    slot = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    columns = np.zeros((int(lengths.max(initial=0)), len(vec)))
    columns[slot, owner] = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths[vec.is_null().to_numpy(zero_copy_only=False)] = -1
    lengths[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    labels = rows.column("label").to_numpy().astype(np.float64)
    return rows.column("vec_id").to_numpy(), columns, lengths, labels


def _block_pairs(queries: tuple, candidates: tuple, graded: bool) -> Iterator[pa.RecordBatch]:
    """Every query with every candidate; a sum takes the slots in order, as :func:`dot` does, and is
    null where the lengths differ or a vector or an entry is null."""
    q_ids, q_cols, q_len, q_lab = queries
    c_ids, c_cols, c_len, c_lab = candidates
    step = max(1, _BLOCK_PAIRS // len(c_ids))
    for c_at in range(0, len(c_ids), _BLOCK_PAIRS):
        cs = slice(c_at, c_at + _BLOCK_PAIRS)
        for q_at in range(0, len(q_ids), step):
            qs = slice(q_at, q_at + step)
            score = np.zeros((len(q_ids[qs]), len(c_ids[cs])))
            with np.errstate(all="ignore"):
                for x, y in zip(q_cols[:, qs], c_cols[:, cs]):
                    score += x[:, None] * y
                apart = np.abs(q_lab[qs, None] - c_lab[cs])
            none = (q_len[qs, None] != c_len[cs]) | (q_len[qs, None] < 0)
            rel = (2 * (apart == 0) + (apart == 1)) if graded else (apart == 0)
            cols = [
                pa.array(np.repeat(q_ids[qs], score.shape[1])),
                pa.array(np.tile(c_ids[cs], score.shape[0])),
                pa.array(score.ravel(), mask=none.ravel() if none.any() else None),
                pa.array(rel.ravel().astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "product_id", "score", "relevant"])


def judge_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge answers, one for each turn of ``conversations``, keyed by ``pair_id``.

    The turn's text is the answer's explanation, its prose or what surrounds the
    JSON; the scores follow its length. Eleven forms, told by ``pair_id % 11``:
    fenced, plain with quoted numbers, no scores, unclosed fence, prose, JSON with
    text behind it, an array, ``NaN``, a key twice, prose around a fence, fences
    inside the explanation.
    """
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    pair, text = F.col("conv_id") * ANSWER_TURNS + F.col("turn"), F.coalesce("text", F.lit(""))
    a, b = (F.length(text) % 11).cast("string"), F.col("turn").cast("string")
    said = F.get_json_object(F.to_json(F.struct(F.array(text).alias("t"))), "$.t")  # ["the text"], escaped
    said = F.substring(said, F.lit(2), F.length(said) - 2)
    best = F.when(F.length(text) % 11 > F.col("turn"), "model_a").when(F.length(text) % 11 < F.col("turn"), "model_b").otherwise("tie")

    def answer(left, right, explanation=said):
        return F.concat(
            F.lit('{"scores":{"model_a":{"relevance":'), left, F.lit('},"model_b":{"relevance":'), right,
            F.lit('}},"overall_better":"'), best, F.lit('","explanation":'), explanation, F.lit("}"),
        )

    quoted = [F.concat(F.lit('"'), x, F.lit('"')) for x in (a, b)]
    nl, fence = F.lit("\n"), F.lit("```")
    forms = [
        F.concat(F.lit("```json\n"), answer(a, b), nl, fence),
        answer(*quoted),
        F.concat(F.lit('  ```\n{"scores":{},"explanation":'), said, F.lit("}\n```  ")),
        F.concat(F.lit("```json "), answer(a, b)),
        text,
        F.concat(answer(a, b), nl, text),
        F.concat(F.lit("["), answer(a, b), F.lit(","), said, F.lit("]")),
        answer(F.lit("NaN"), b),
        answer(F.concat(a, F.lit(',"relevance":'), b), b),
        F.concat(text, F.lit("\n```json\n"), answer(a, b), nl, fence),
        F.concat(F.lit("```JSON\n"), answer(a, b, F.concat(F.lit('"``` '), F.substring(said, F.lit(2), F.length(said)))), nl, fence, nl, text),
    ]
    raw = forms[-1]
    for i, form in list(enumerate(forms))[-2::-1]:
        raw = F.when(pair % len(forms) == i, form).otherwise(raw)
    return c.select(pair.alias("pair_id"), raw.alias("raw_text"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics documents of many runs, one a user and event type of ``events``:
    distinct values are the queries, events the texts, and the span of their
    times the run's seconds (0 for a single event). Every seventh user's runs
    have no time, every fifth's no texts."""
    e = read_table(spark, sf_dir, "events", ["user_id", "event_type", "ts", "value"])
    runs = e.groupBy("user_id", "event_type").agg(
        F.countDistinct("value").alias("num_queries"), F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("span")
    )
    days, hours, minutes, rest = (F.extract(F.lit(u), F.col("span")) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    seconds = ((days * 24 + hours) * 60 + minutes) * 60 + rest
    runs = runs.withColumn("seconds", seconds.cast("double"))
    return runs.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("exp_name"),
        "num_queries",
        F.when(F.col("user_id") % 7 != 0, F.col("seconds")).alias("total_time_sec"),
        F.when(F.col("user_id") % 5 != 0, F.col("n")).alias("total_texts_embedded"),
    )


def catalog_events(catalog: DataFrame, conversations: DataFrame, step: int) -> DataFrame:
    """Stand-in feed of :mod:`shelfrank.streaming.maintained` in three steps.

    Products: English and German ones arrive, then French and Italian ones while English and
    German ones without a brand are renamed to their bare name, then those without a type vanish and
    the first rows of the renamed ones come again, late. Queries: user turns 0, then 1 and 2, then the rest.
    """
    first = F.col("PageLanguage").isin("en", "de")
    renamed = first & F.col("BrandName").isNull()
    text, name = F.col("product_text"), F.coalesce("ProductName", F.lit(""))

    def rows(where, seq, text, deleted=False):
        return catalog.where(where).select(
            F.lit(None).cast("string").alias("query"), "product_id", F.lit(seq).cast("bigint").alias("seq"),
            F.lit(deleted).alias("deleted"), text.cast("string").alias("product_text"),
        )

    products = {
        0: lambda: rows(first, 1, text),
        1: lambda: rows(~first, 2, text).unionByName(rows(renamed, 2, name)),
        2: lambda: rows(F.col("ProductType").isNull(), 3, F.lit(None), True).unionByName(rows(renamed, 1, text)),
    }[step]()
    turns = {0: F.col("turn") == 0, 1: F.col("turn").between(1, 2), 2: F.col("turn") > 2}[step]
    asked = conversations.where((F.col("role") == "user") & turns).select(F.col("text").alias("query"))
    return products.unionByName(asked, allowMissingColumns=True)
