"""Text encoding (F1, F2, F5) and the persistent embedding cache (A10).

Texts are made distinct **before** encoding, encoded once, and joined back on
the text: an encoder never sees the same text twice in one plan.

Two encoder kinds share one contract (``encode(df, text_col) -> df + embedding``):

* :class:`HashingEncoder` — default, pure Spark expressions (JVM, no Python
  worker): token counts per md5 bucket. Counts are integers, so dot products
  and norms are exact and scores equal those of any other engine bit for bit.
* :class:`BatchEncoder` — any user ``list[str] -> ndarray`` model, run through
  ``predict_batch_udf`` (Arrow batches, model loaded once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.functions.text import with_prefix
from shelfrank.functions.vectors import hashing_counts, l2_normalize, squared_norm


class HashingEncoder:
    """Lexical stand-in encoder: bucketed token counts of dimension ``dim``.

    ``normalized`` is False: scores from this encoder are cosines computed from
    the raw counts (see :func:`shelfrank.operators.ranking.score_pairs`).
    """

    normalized = False
    # Encoding a row costs less than the shuffle + join that distinct-before-
    # encode needs, so callers encode rows in place with this encoder.
    per_row = True

    def __init__(self, dim: int = 64, model_id: str | None = None):
        if dim < 1:
            raise ValueError("dim must be >= 1")
        self.dim = dim
        self.model_id = model_id or f"hashing-{dim}"

    def column(self, text: Column | str) -> Column:
        return hashing_counts(text, self.dim).cast(T.ArrayType(T.FloatType()))

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return df.withColumn(out_col, self.column(F.col(text_col)))


class BatchEncoder:
    """Wrap a ``make_fn() -> (list[str] -> ndarray[n, dim])`` factory as a batch UDF.

    ``normalized`` states whether the model already returns unit vectors (then
    scoring is a plain dot product).
    """

    per_row = False  # model inference: encode each distinct text once

    def __init__(
        self,
        make_fn: Callable[[], Callable],
        dim: int,
        model_id: str,
        batch_size: int = 64,
        normalized: bool = True,
    ):
        self.make_fn = make_fn
        self.dim = dim
        self.model_id = model_id
        self.batch_size = batch_size
        self.normalized = normalized

    def _udf(self):
        from pyspark.ml.functions import predict_batch_udf

        make_fn = self.make_fn

        def make_predict():
            fn = make_fn()

            def predict(texts):
                import numpy as np

                out = np.asarray(fn([str(t) for t in texts.tolist()]), dtype=np.float32)
                return out

            return predict

        return predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=self.batch_size)

    def column(self, text: Column | str) -> Column:
        return self._udf()(text)

    def encode(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        from shelfrank.session import ship_package

        ship_package(df.sparkSession)
        return df.withColumn(out_col, self.column(F.col(text_col)))


def distinct_texts(df: DataFrame, text_col: str, prefix: str | None = None, out_col: str = "text") -> DataFrame:
    """Distinct non-null texts (optionally with an encoder prefix)."""
    t = F.col(text_col)
    expr = with_prefix(prefix, t) if prefix is not None else t
    return df.where(t.isNotNull()).select(expr.alias(out_col)).distinct()


def encode_distinct(
    df: DataFrame, text_col: str, encoder, prefix: str | None = None, out_col: str = "embedding"
) -> DataFrame:
    """F1 on distinct texts: ``(text, embedding, sq_norm)`` — one row per distinct text."""
    d = distinct_texts(df, text_col, prefix=prefix, out_col="text")
    enc = encoder.encode(d, "text", out_col)
    return enc.withColumn("sq_norm", squared_norm(out_col))


def normalize_vectors(df: DataFrame, vec_col: str, out_col: str | None = None) -> DataFrame:
    """L2 normalisation; a zero vector stays as it is."""
    return df.withColumn(out_col or vec_col, l2_normalize(vec_col))


def cache_delta(texts: DataFrame, cache: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts not yet in the cache (left anti join on the text)."""
    return texts.join(cache.select(F.col(text_col).alias(text_col)), text_col, "left_anti")


def cached_encode(
    spark,
    texts: DataFrame,
    encoder,
    cache_path: str,
    text_col: str = "text",
) -> DataFrame:
    """A10: ``text, embedding`` of all requested texts; only those without a vector in
    the model's cache under ``cache_path`` are encoded, and committed to it
    (:class:`shelfrank.operators.vector_cache.VectorCache`)."""
    from shelfrank.operators.vector_cache import VectorCache

    cache = VectorCache(spark, cache_path, encoder.model_id)
    cache.append(texts, encoder, text_col)
    return cache.lookup(texts, text_col)
