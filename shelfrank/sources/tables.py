"""Parquet scans of the base tables with declared schemas.

Reads declare the schema (no inference) and select only the needed columns so
``ReadSchema`` in the plan is pruned; filters applied later are pushed to the
parquet scan by Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS = T.TimestampType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BASE_SCHEMAS: dict[str, T.StructType] = {
    "part": _st(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                ("p_retailprice", _D)),
    "lineitem": _st(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                    ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                    ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)),
    "orders": _st(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                  ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "customer": _st(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
                    ("c_mktsegment", _S)),
    "embeddings": _st(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType(), True)), ("label", _I)),
    "conversations": _st(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "documents": _st(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table_glob(sf_dir: str, name: str) -> str:
    """The table's path as a pattern: a stream's source folder, be the table one file or a folder of files."""
    return f"{sf_dir.rstrip('/')}/{{{name}.parquet}}"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan one base table; ``columns`` prunes the read schema."""
    schema = BASE_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
