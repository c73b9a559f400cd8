"""Seeded ordering keys: a reproducible stand-in for a seeded random shuffle.

``md5(seed ':' key)`` gives the same order in Spark and in any SQL engine with
md5, so "shuffle with seed 42, take the first n" is exact and checkable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfrank.functions.text import ColumnOrName, _c

DEFAULT_SEED = 42
NULL_MARK = "\u0001"


def row_key(cols: Sequence[ColumnOrName]) -> Column:
    """A string key of several columns; nulls are marked so they differ from ''."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_MARK)) for c in cols]
    return F.concat_ws(":", *parts) if len(parts) > 1 else parts[0]


def seeded_hash(key: ColumnOrName, seed: int | str = DEFAULT_SEED) -> Column:
    """md5 hex of ``seed:key`` — the seeded shuffle order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash_bucket(h: ColumnOrName, hex_digits: int = 4) -> Column:
    """Leading hex digits of an md5 as a bucket number (uniform because md5)."""
    return F.conv(F.substring(_c(h), 1, hex_digits), 16, 10).cast("int")
