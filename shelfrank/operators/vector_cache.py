"""Persistent vector cache (A10, F5): content-addressed rows, snapshots, atomic commits.

Layout under ``<path>/<model>/``: ``data/<id>/bucket=<n>/*.parquet`` holds rows
``key, text, embedding``, ``key`` being the SHA-256 of the text and ``bucket`` its
leading bits; ``snapshots/<number>.json`` lists the data folders that make up one state.

An append writes a new data folder first and then renames a finished manifest into
place; a name that is taken makes the commit fail, and the append looks again at what is missing
and tries anew. So a crash between the two leaves only a folder that no snapshot names,
readers keep the snapshot they opened, and a key is never in one snapshot twice: nothing is
regrouped when reading.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Commits that are tried when other writers come first.
TRIES = 10

ROWS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("bucket", T.IntegerType()),
])


class CommitConflict(Exception):
    """Another writer has committed the snapshot of this number."""


class VectorCache:
    """Vectors of one model under ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str, model_id: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.root = f"{path.rstrip('/')}/{''.join(c if c.isalnum() or c in '-_.' else '_' for c in model_id)}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    # --- snapshots

    def version(self) -> int:
        """Number of the newest snapshot; 0 before the first append."""
        folder = self._path(f"{self.root}/snapshots")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> list[str]:
        """Data folders of a snapshot (the newest one by default)."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        text = self.spark.read.text(f"{self.root}/snapshots/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)["folders"]

    def _commit(self, base: int, folders: list[str]) -> int:
        """Publish ``folders`` as the snapshot after ``base``; fails if another writer was first."""
        target = self._path(f"{self.root}/snapshots/{base + 1:08d}.json")
        draft = self._path(f"{self.root}/snapshots/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": base + 1, "folders": folders}).encode()))
        out.close()
        try:
            self._files.rename(draft, target, self._no_options)  # never overwrites
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise CommitConflict(str(target)) from e
            raise
        return base + 1

    # --- rows

    def _keyed(self, texts: DataFrame, text_col: str) -> DataFrame:
        rows = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
        lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        return rows.withColumn("key", F.sha2("text", 256)).select("key", "text", F.pmod(lead, F.lit(self.buckets)).cast("int").alias("bucket"))

    def read(self, version: int | None = None, folders: list[str] | None = None) -> DataFrame:
        """Rows ``key, text, embedding, bucket`` of a snapshot."""
        folders = self.folders(version) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/{f}" for f in folders]).select(*ROWS.names)

    def _write(self, rows: DataFrame) -> str:
        folder = f"part={uuid.uuid4().hex}"
        rows.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return folder

    def missing(self, texts: DataFrame, text_col: str = "text", version: int | None = None) -> DataFrame:
        """Distinct texts without a vector in a snapshot: ``key, text, bucket``. Only the cache's keys are read."""
        return self._keyed(texts, text_col).join(self.read(version).select("bucket", "key"), ["bucket", "key"], "left_anti")

    def append(self, texts: DataFrame, encoder, text_col: str = "text") -> list[str]:
        """Encode the texts that are missing and commit them; the new data folders (none if nothing was missing)."""
        for _ in range(TRIES):
            base = self.version()
            new = encoder.encode(self.missing(texts, text_col, base), "text", "embedding")
            folder = self._write(new.select("key", "text", F.col("embedding").cast("array<float>").alias("embedding"), "bucket"))
            if self.read(folders=[folder]).isEmpty():
                return []
            try:
                self._commit(base, [*self.folders(base), folder])
                return [folder]
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} other commits came first")

    def compact(self) -> int:
        """Rewrite the newest snapshot as one data folder; earlier snapshots stay readable. Returns its version."""
        for _ in range(TRIES):
            base = self.version()
            folders = self.folders(base)
            if len(folders) < 2:
                return base
            folder = self._write(self.read(folders=folders))
            try:
                return self._commit(base, [folder])
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} other commits came first")

    def lookup(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """``text, embedding`` of the distinct texts that the newest snapshot holds."""
        wanted = self._keyed(texts, text_col)
        return wanted.join(self.read().select("bucket", "key", "embedding"), ["bucket", "key"]).select("text", "embedding")

    def unused(self) -> list[str]:
        """Data folders that no snapshot names: left by crashes and lost races."""
        data = self._path(f"{self.root}/data")
        if not self._fs.exists(data):
            return []
        named = {f for v in range(1, self.version() + 1) for f in self.folders(v)}
        return sorted({s.getPath().getName() for s in self._fs.listStatus(data)} - named)

