"""M1, the other side: stored top-k lists that follow the catalog.

One event stream carries two kinds of rows: a query that is asked (``query``), and a
product that arrives, changes or vanishes (``product_id, seq, deleted, product_text``).
After every micro-batch the stored lists equal a batch search of the live queries over
the live catalog, but only what the batch touched is scored:

* The batch's products are searched for every live query (the pruned search of
  :mod:`shelfrank.operators.search`) and merged into the stored lists.
* A list holds up to ``depth`` > k hits and a ``floor``: every unlisted product ranks
  below it. Hits at or above the floor are certain. While k of them are left nothing
  else is read; otherwise that query alone is searched over the whole catalog again.
* A query that was not asked for ``ttl`` batches is forgotten. Asked again, it is new.

State is a log: ``catalog/batch_id=n`` and ``lists/batch_id=n`` hold the rows that batch
``n`` changed, and every ``compact_every``-th batch holds all of them, so a reader takes
the batches from the last full one on. Batch ``n`` reads only batches before it and
overwrites its own folder: a replay, or a crash between the two writes, gives the same state.

Defined results: the row of largest ``seq`` wins (a deletion wins a tie), also over what was
applied in earlier batches, so late and repeated rows change nothing; rows without ``seq``
count as the oldest; a null text counts as empty; blank queries are skipped. A vanished
product keeps its id and number, without vector, so that late rows of it stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.text import PASSAGE_PREFIX, QUERY_PREFIX, ustrip, with_prefix
from shelfrank.functions.vectors import squared_norm
from shelfrank.operators.encode import encode_distinct
from shelfrank.operators.ranking import order_struct
from shelfrank.operators.search import catalog_topk
from shelfrank.session import materialize

EVENTS = (
    T.StructType().add("query", "string").add("product_id", "long").add("seq", "long").add("deleted", "boolean").add("product_text", "string")
)
#: A hit compares as it ranks: NaN last, larger score first, smaller id first.
HIT = "struct<f: boolean, s: double, k: bigint, score: double>"


def _vectors(rows: DataFrame, text: str, prefix: str, encoder, vec: str, sq: str) -> DataFrame:
    """``rows`` with the vector of the prefixed text and its squared norm."""
    if getattr(encoder, "per_row", False):
        rows = rows.withColumn(vec, encoder.column(with_prefix(prefix, text)))
        return rows.withColumn(sq, squared_norm(vec).cast("double"))
    v = encode_distinct(rows, text, encoder, prefix=prefix)
    v = v.select(F.col("text").alias("_t"), F.col("embedding").alias(vec), F.col("sq_norm").cast("double").alias(sq))
    return rows.withColumn("_t", with_prefix(prefix, text)).join(v, "_t").drop("_t")


def _hit() -> Column:
    o = order_struct("score", "product_id")
    return F.struct(o["f"].alias("f"), o["s"].alias("s"), o["k"].alias("k"), F.col("score").alias("score")).cast(HIT)


@dataclass(frozen=True)
class MaintainedTopK:
    """Stored lists of the best ``k`` products of every live query under ``path`` (a shared folder)."""

    path: str
    encoder: object
    k: int
    depth: int
    ttl: int = 1_000
    compact_every: int = 16

    def __post_init__(self):
        if not 1 <= self.k <= self.depth or self.ttl < 0 or self.compact_every < 1:
            raise ValueError("1 <= k <= depth, ttl >= 0 and compact_every >= 1 are needed")

    # --- the log -------------------------------------------------------------------

    def _log(self, spark: SparkSession, part: str, upto: int, key: str) -> DataFrame:
        """Latest row per key after batch ``upto``."""
        first = upto // self.compact_every * self.compact_every
        rows = spark.read.parquet(f"{self.path}/{part}").where(F.col("batch_id").between(first, upto))
        rest = [c for c in rows.columns if c not in (key, "batch_id")]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
        return latest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])

    def _write(self, rows: DataFrame, part: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/batch_id={batch_id}")

    def _full(self, batch_id: int) -> bool:
        return batch_id % self.compact_every == 0

    def catalog(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Products after a batch, vanished ones included: ``product_id, seq, deleted, p_emb, p_sq``."""
        return self._log(spark, "catalog", batch_id, "product_id")

    def lists(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Lists of the queries that are live after a batch, one row a query."""
        return self._log(spark, "lists", batch_id, "query").where(F.col("asked") >= batch_id - self.ttl)

    def top(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """``query, product_id, score, rank`` (1 to k) after a batch."""
        hits = self.lists(spark, batch_id).select("query", F.posexplode(F.slice("hits", 1, self.k)).alias("at", "h"))
        return hits.select("query", F.col("h.k").alias("product_id"), F.col("h.score").alias("score"), (F.col("at") + 1).alias("rank"))

    # --- one batch -----------------------------------------------------------------

    def _search(self, queries: DataFrame, products: DataFrame) -> DataFrame:
        """Best ``depth`` hits of each query among ``products``: ``query, found`` in rank order.
        ``queries`` is written already: if none is there, the products are not read."""
        if queries.isEmpty():
            return queries.select("query", F.array().cast(f"array<{HIT}>").alias("found"))
        hits = catalog_topk(queries, products, self.depth, "query", "product_id", normalized=self.encoder.normalized)
        return hits.groupBy("query").agg(F.array_sort(F.collect_list(_hit())).alias("found"))

    def _changes(self, events: DataFrame, batch_id: int) -> DataFrame:
        """Products of the batch that are newer than what the log has, with their vectors."""
        gone = F.coalesce("deleted", F.lit(False))
        number = F.coalesce("seq", F.lit(-(2**63)))
        rows = events.where(F.col("product_id").isNotNull()).select(
            "product_id", F.struct(number.alias("seq"), gone.alias("deleted"), F.coalesce("product_text", F.lit("")).alias("text")).alias("r")
        )
        rows = rows.groupBy("product_id").agg(F.max("r").alias("r")).select("product_id", "r.*")
        if batch_id > 0:
            had = self.catalog(events.sparkSession, batch_id - 1).select("product_id", F.col("seq").alias("had"))
            rows = rows.join(had, "product_id", "left").where(F.col("had").isNull() | (F.col("seq") > F.col("had"))).drop("had")
        live = _vectors(rows.where(~F.col("deleted")), "text", PASSAGE_PREFIX, self.encoder, "p_emb", "p_sq")
        none = [F.lit(None).cast(live.schema[c].dataType).alias(c) for c in ("p_emb", "p_sq")]
        cols = ["product_id", "seq", "deleted", "p_emb", "p_sq"]
        return live.select(*cols).unionByName(rows.where("deleted").select("product_id", "seq", "deleted", *none))

    def _merged(self, kept: DataFrame, changes: DataFrame) -> DataFrame:
        """Lists after the batch: what is left of them and the batch's products, as far as certain."""
        old = kept.select("query", F.explode("hits").alias("h")).withColumn("product_id", F.col("h.k"))
        old = old.join(changes.select("product_id"), "product_id", "left_anti")
        old = old.groupBy("query").agg(F.collect_list("h").alias("left"))
        live = changes.where(~F.col("deleted"))
        new = self._search(kept.limit(0) if live.isEmpty() else kept, live)
        empty = F.array().cast(f"array<{HIT}>")
        both = F.concat(F.coalesce("left", empty), F.coalesce("found", empty))
        rows = kept.join(old, "query", "left").join(new, "query", "left").withColumn("all", F.array_sort(both))
        sure = F.when(F.col("whole"), F.col("all")).otherwise(F.filter("all", lambda h: h <= F.col("floor")))
        rows = rows.withColumn("sure", sure)
        cut = F.size("sure") >= self.depth
        return rows.select(
            "query", "q_emb", "q_sq", "asked",
            (F.col("whole") & ~cut).alias("whole"),
            F.when(cut, F.element_at(F.slice("sure", 1, self.depth), -1)).otherwise(F.col("floor")).alias("floor"),
            F.slice("sure", 1, self.depth).alias("hits"),
            (~F.col("whole") & (F.size("sure") < self.k)).alias("short"),
            F.struct("was", "whole", "floor", "hits").alias("before"),
        )

    def _refilled(self, queries: DataFrame, batch_id: int) -> DataFrame:
        """Lists of ``queries`` from the whole catalog after the batch."""
        live = self.catalog(queries.sparkSession, batch_id).where(~F.col("deleted"))
        empty = F.array().cast(f"array<{HIT}>")
        rows = queries.join(self._search(queries, live), "query", "left").withColumn("hits", F.coalesce("found", empty))
        full = F.size("hits") >= self.depth
        floor = F.when(full, F.element_at("hits", -1))
        return rows.select("query", "q_emb", "q_sq", "asked", (~full).alias("whole"), floor.alias("floor"), "hits")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Bring catalog and lists from the state after ``batch_id - 1`` to the state after this batch."""
        spark, cols = batch.sparkSession, ["query", "q_emb", "q_sq", "asked", "whole", "floor", "hits"]
        events = materialize(batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS]))
        changes = self._changes(events, batch_id)
        if self._full(batch_id) and batch_id > 0:
            changes = materialize(changes)
            rest = self.catalog(spark, batch_id - 1).join(changes.select("product_id"), "product_id", "left_anti")
            self._write(rest.unionByName(changes), "catalog", batch_id)
        else:  # the batch's own folder holds just its changes
            self._write(changes, "catalog", batch_id)
            changes = spark.read.parquet(f"{self.path}/catalog/batch_id={batch_id}")

        asked = events.select(ustrip("query").alias("query")).where(F.col("query") != "").distinct()
        unknown = asked
        if batch_id > 0:
            known = self.lists(spark, batch_id - 1).withColumn("was", F.col("asked"))
            now = known.join(asked.withColumn("now", F.lit(True)), "query", "left")
            now = now.withColumn("asked", F.when(F.col("now"), F.lit(batch_id).cast("long")).otherwise(F.col("asked"))).drop("now")
            kept = materialize(now.where(F.col("asked") >= batch_id - self.ttl))
            unknown = asked.join(kept.select("query"), "query", "left_anti")
        new = _vectors(unknown, "query", QUERY_PREFIX, self.encoder, "q_emb", "q_sq")
        search = new.withColumn("asked", F.lit(batch_id).cast("long"))
        if batch_id > 0:
            merged = materialize(self._merged(kept, changes))
            search = search.unionByName(merged.where("short").select(*search.columns))
        search = materialize(search)
        out = self._refilled(search, batch_id).select(*cols)
        if batch_id > 0:
            same = F.col("before").eqNullSafe(F.struct(F.col("asked").alias("was"), "whole", "floor", "hits"))
            stays = merged.where(~F.col("short"))
            out = out.unionByName((stays if self._full(batch_id) else stays.where(~same)).select(*cols))
        self._write(out, "lists", batch_id)


def run_maintained(spark: SparkSession, source_dir: str, store: MaintainedTopK, checkpoint_path: str, available_now: bool = True):
    """Follow the event files of ``source_dir`` (schema :data:`EVENTS`). With ``available_now`` what
    is there is one batch, and the query stops; a later call goes on from the checkpoint."""
    stream = spark.readStream.schema(EVENTS).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(store.apply).option("checkpointLocation", checkpoint_path)
    q = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q
