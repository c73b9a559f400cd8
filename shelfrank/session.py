"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; a cluster passes its own values through
# spark-submit and those win because ``getOrCreate`` keeps an existing session.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shelfrank", extra_conf: dict | None = None
) -> SparkSession:
    """A local session for tests and the bench (never used by operators)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**SCALE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SHELFRANK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def default_parallelism(spark: SparkSession, fallback: int = 8) -> int:
    """Task slots of the session (a config read; also works without a SparkContext)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        return int(spark.conf.get("spark.default.parallelism", str(fallback)) or fallback)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is used as is. Only when
    it is unset (local tests) a private folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the checkpoint folder
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="shelfrank-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make ``shelfrank`` code usable in executor Python workers.

    Operators that run Python on workers (grouped pandas functions, batch
    encoders, judges) reference module-level helpers. They are registered to
    be pickled *by value*, so workers need no copy of the package and nothing
    is written to a machine-local folder. (``spark`` is kept for the API.)"""
    import shelfrank
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(shelfrank)


def materialize(df):
    """Write ``df`` once as parquet in the shared checkpoint folder and continue from the written copy.

    Used where one intermediate feeds several branches of a plan: Catalyst
    prunes columns differently per branch, so without this the upstream joins
    would run once per branch. It also cuts the lineage (a lost executor
    re-reads files), and every branch reads only the columns and rows it needs.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/shelfrank/{name}-{uuid.uuid4().hex[:12]}"
