"""Vector expressions on ``array<float|double>`` columns and the hashing encoder.

PySpark 4.1 has no vector SQL functions, so dot products are ``zip_with`` +
``aggregate`` — an ordered double sum, equal bit for bit to an ordered sum
in any other engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import ColumnOrName, _c


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Ordered double dot product; null when the lengths differ."""
    a, b = _c(a), _c(b)
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def squared_norm(v: ColumnOrName) -> Column:
    return dot(v, v)


def l2_normalize(v: ColumnOrName) -> Column:
    """v / ||v||; a zero vector is returned unchanged."""
    v = _c(v)
    norm = F.sqrt(squared_norm(v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def cosine_from_dot(dot_ab: ColumnOrName, sq_a: ColumnOrName, sq_b: ColumnOrName) -> Column:
    """dot / (sqrt(|a|^2) * sqrt(|b|^2)); 0 when either vector is zero."""
    den = F.sqrt(_c(sq_a)) * F.sqrt(_c(sq_b))
    return F.when(den > 0, _c(dot_ab) / den).otherwise(F.lit(0.0))


# --- hashing encoder --------------------------------------------------------
# Token rule: lower-case, split on anything that is not a letter or a digit.
# Bucket rule: first 8 hex digits of md5(token) as an unsigned number, modulo dim.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: ColumnOrName) -> Column:
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda t: t != "")


def token_bucket(token: Column, dim: int) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % F.lit(dim)


def hashing_counts(text: ColumnOrName, dim: int) -> Column:
    """Dense ``array<int>`` of token counts per bucket (length ``dim``)."""
    buckets = F.transform(tokens(text), lambda t: token_bucket(t, dim).cast("int"))
    zero = F.array_repeat(F.lit(0), dim)
    return F.aggregate(
        buckets, zero, lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1).otherwise(x))
    )
