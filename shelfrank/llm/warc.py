"""Operator 7: deterministic sharded WARC writer and reader.

Pages are dealt to shards by ranges of their id, of about equal bytes, taken
from an exact byte histogram; a shard is sorted and streamed into gzip members,
and a new file starts when the compressed size passes a limit. Files get a
temporary name, are renamed when whole, and count only if a manifest row lists
them, so a task that runs again writes the same bytes over the same names.
Equal payloads are stored once; the others become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.llm.common import python_ready, written
from shelfrank.session import scratch_path

#: Payload bytes a shard aims at, and compressed bytes after which a file is closed.
SHARD_BYTES, FILE_BYTES = 16 << 20, 4 << 20
#: Buckets of the byte histogram over the ids (the broadcast table's bound).
RANGES = 1 << 14
#: A shard's pages are spread over so many parts, each with files of its own.
SPREAD = 4

_DATE = "2024-01-01T00:00:00Z"  # fixed: reruns write the same bytes
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, block_ok boolean"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _line(value: str | None) -> str:
    """A header value: no line breaks or control characters, non-ASCII as %XX."""
    return "".join(c if " " < c < "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def _unline(value: str) -> str:
    return b"".join(bytes([int(p[:2], 16)]) + p[2:] if i else p for i, p in enumerate(value.encode().split(b"%"))).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with regenerated headers, lengths and digests."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url or '', digest)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-No-Url: {int(url is None)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_members(data: bytes) -> Iterator[dict]:
    """The records of an archive, one gzip member after the other."""
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        data = z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        http_fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
        number = lambda x: int(x) if x else None
        kind = fields["WARC-Type"]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        yield {
            "page_id": number(fields["X-Page-Id"]), "url": None if fields["X-No-Url"] == "1" else _unline(fields["WARC-Target-URI"]), "record_type": kind,
            "payload_bytes": int(http_fields["Content-Length"]), "payload_digest": digest, "refers_to": number(fields.get("X-Refers-To-Page-Id", "")),
            "payload": None if kind == "revisit" else body,
            "block_ok": fields["WARC-Block-Digest"] == f"sha1:{digest32(block)}" and (kind == "revisit" or (digest32(body) == digest and len(body) == int(http_fields["Content-Length"]))),
        }


class _Roller:
    """Writes the files of one shard part."""

    def __init__(self, base: str, shard: int, part: int, limit: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(base)
        self.base, self.limit, self.name, self.no = base, limit, f"shard-{shard:05d}-{part:02d}", 0
        self.shard, self.out, self.done = shard, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.tmp = f"{self.root}/.{self.name}-{self.no:05d}.{uuid.uuid4().hex}.tmp"
            self.out, self.bytes, self.records, self.sum = self.fs.open_output_stream(self.tmp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)
        self.records += 1
        if self.bytes >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.name}-{self.no:05d}.warc.gz"
        self.fs.move(self.tmp, f"{self.root}/{final}")
        self.done.append((final, self.shard, self.records, self.bytes, self.sum.hexdigest()))
        self.out, self.no = None, self.no + 1


def _shards(slim: DataFrame, shard_bytes: int) -> DataFrame:
    """``w_range -> shard``: id ranges of about ``shard_bytes``, from a histogram."""
    hist = slim.groupBy("w_range").agg(F.sum("w_bytes").alias("w_sum"))
    w = Window.orderBy("w_range").rowsBetween(Window.unboundedPreceding, -1)
    return hist.select("w_range", F.floor(F.coalesce(F.sum("w_sum").over(w), F.lit(0)) / F.lit(shard_bytes)).cast("int").alias("w_shard"))


def write_warc(pages: DataFrame, path: str, *, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives under ``path``; returns the manifest.

    Null html is an empty payload. Payloads of at least ``min_revisit_bytes`` that
    occur again become revisits of the row with the smallest page_id (null ids
    last; equal ids by url). Rows repeated whole are records of their own, the
    first one the response; rows that share id and url follow each other in one file,
    in the order read. Where ids and urls are unique the files hold the same bytes
    however the input is partitioned. An empty table writes an empty manifest. Extra
    columns are not read.
    """
    spark = pages.sparkSession
    lo, hi = pages.agg(F.min("page_id"), F.max("page_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // RANGES + 1)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("w_payload"))
    rows = rows.withColumn("w_range", F.coalesce(F.floor((F.col("page_id") - F.lit(lo or 0)) / F.lit(width)).cast("int"), F.lit(RANGES)))
    rows = rows.withColumn("w_row", F.monotonically_increasing_id())
    # one narrow row a page: bytes and digest
    slim = written(rows.select("page_id", "url", "w_range", "w_row", (F.octet_length("w_payload") + 500).alias("w_bytes"), F.octet_length("w_payload").alias("w_len"), F.sha1("w_payload").alias("w_sha")), "warc-slim")
    first = slim.groupBy("w_sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.col("url").isNull().alias("u"), "url", "w_row")).alias("w_first"), F.count("*").alias("w_n")).where("w_n > 1")
    again = slim.where(F.col("w_len") >= min_revisit_bytes).join(first, "w_sha").where(F.col("w_row") != F.col("w_first.w_row"))
    decisions = again.select("page_id", "url", "w_range", "w_row", F.col("w_first.page_id").alias("w_refers"))
    shards = F.broadcast(_shards(slim, shard_bytes))  # at most RANGES + 1 rows
    # decisions ride in the same shuffle as the pages and sort before them: the payloads move once
    both = rows.select("page_id", "w_row", F.lit(1).alias("w_kind"), "url", "w_payload", F.lit(None).cast("long").alias("w_refers"), "w_range").unionByName(
        decisions.select("page_id", "w_row", F.lit(0).alias("w_kind"), "url", F.lit(None).cast("binary").alias("w_payload"), "w_refers", "w_range")
    )
    both = both.join(shards, "w_range").withColumn("w_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int"))
    both = both.select("w_shard", "w_part", "page_id", "w_row", "w_kind", "url", "w_payload", "w_refers")
    dealt = python_ready(both.repartition("w_shard", "w_part").sortWithinPartitions("w_shard", "w_part", F.col("page_id").asc_nulls_last(), "url", "w_row", "w_kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, decided = None, None, None

        def manifest():
            cols = list(zip(*roller.done, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "shard", "records", "bytes", "sha256"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for shard, part, page_id, row, kind, url, payload, refers in zip(*cols, strict=True):
                if at != (shard, part):
                    if roller:
                        roller.close()
                        yield manifest()
                    roller, at = _Roller(path, shard, part, file_bytes), (shard, part)
                if kind == 0:
                    decided = (page_id, row, refers)
                else:
                    revisit = decided is not None and decided[:2] == (page_id, row)
                    roller.write(member(make_record(page_id, url, payload, decided[2] if revisit else None, revisit)))
        if roller:
            roller.close()
            yield manifest()

    _make_dir(path)
    manifest = dealt.mapInArrow(run, _MANIFEST)
    # the manifest appears whole or not at all (Spark's own commit)
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")


def _make_dir(path: str) -> None:
    from pyarrow import fs

    f, root = fs.FileSystem.from_uri(path)
    f.create_dir(root, recursive=True)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that the manifest lists, headers decoded,
    payloads unpacked and their digests checked (``block_ok``)."""
    listed = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").select(F.col("file").alias("m_file"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("m_name"), "content")
    # names only on the other side; a file that no manifest row names is not read
    files = python_ready(files.join(listed, F.col("m_name") == F.col("m_file"), "left_semi").select("content"))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for r in parse_members(content.as_py()):
                    out.append([r[k] for k in names])
                    size += r["payload_bytes"]
                    if size > 4 << 20:
                        yield _batch(out, names, types)
                        out, size = [], 0
                if out:
                    yield _batch(out, names, types)

    return files.mapInArrow(run, _RECORD)


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def warc_path(spark: SparkSession) -> str:
    """A fresh archive folder under the shared checkpoint folder, as a URI."""
    p = scratch_path(spark, "warc")
    return p if ":" in p.split("/")[0] else f"file://{p}"
