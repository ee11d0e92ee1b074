"""Operator 4, WARC: a deterministic sharded writer, and its reader.

1. One pass over the payloads takes their SHA-1 and size in the JVM; digests
   that occur more than once get their smallest id by a pre-aggregated
   ``groupBy`` on (digest, id) rows only.
2. Records are sorted by (id, digest) into shards: a shard begins wherever the
   exact running sum of payload bytes passes another ``shard_bytes`` (a
   two-level scan over ids and sizes only), so the same rows give the same
   shards, however they are partitioned.  The shards' first keys, one for each
   ``shard_bytes`` of payload, are what the driver holds.
3. A task writes whole shards: one gzip member per record (no time stamps),
   headers and digests made from the payload, a new file whenever the
   compressed size passes ``FILE_BYTES``.  A file is written under ``_temporary``
   and renamed when it is complete; a repeated attempt finds the same bytes in
   its place and leaves them.
4. The tasks' rows are the manifest, committed by Spark's own writer after
   all files are in place; the reader takes only files that it names.

Records of equal payloads of at least ``min_bytes``: that of the smallest id
is the response, the others revisit it and carry no payload.

Defined cases: a null payload is an empty one; a null id sorts first, is
written without an id header and read back as null; of repeated rows of one
id and payload the first is the response and the others revisit it; an empty
table writes an empty manifest; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm.common import bounded_batches, scratch
from flowlens.operators.scan import ordered_parts, running
from flowlens.session import checkpoint_dir

SHARD_BYTES = 24 << 20   # payload bytes of a shard
FILE_BYTES = 4 << 20     # compressed bytes after which a file is rolled
BROADCAST_ROWS = 100_000
WARC_DATE = "2020-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "file string, bytes long, sha256 string, records long, first_id long, last_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{nth}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member holding one WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    data = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id, url: str, payload: bytes, refers_to, is_revisit: bool, nth: int) -> bytes:
    digest = base32_sha1(payload)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if is_revisit else http + payload
    headers = [("WARC-Type", "revisit" if is_revisit else "response"),
               ("WARC-Record-ID", record_uri(page_id, digest, nth)),
               ("WARC-Date", WARC_DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if is_revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_uri(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-ID", str(refers_to)))
    return member(headers, block)


class ShardWriter:
    """Rolls the files of one shard; ``rows`` is their part of the manifest."""

    def __init__(self, root: str, shard: int, attempt: int, file_bytes: int):
        import pyarrow.fs
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(root)
        self.shard, self.attempt, self.file_bytes = shard, attempt, file_bytes
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        self.rows: list[dict] = []
        self.out = None

    def commit(self, temporary: str, target: str) -> None:
        """Give a complete file its name.  One that is there already is that of
        an earlier attempt: it stays if it is whole, and goes if not (renaming
        onto a file is refused by some file systems)."""
        there = self.fs.get_file_info(target)
        if there.is_file:
            if there.size == self.size:
                with self.fs.open_input_stream(target, compression=None) as f:
                    if hashlib.sha256(f.read()).digest() == self.sha.digest():
                        self.fs.delete_file(temporary)
                        return
            self.fs.delete_file(target)
        self.fs.move(temporary, target)

    def open(self, page_id):
        self.name = f"shard-{self.shard:06d}-{len(self.rows):05d}.warc.gz"
        self.temporary = f"{self.root}/_temporary/{self.attempt}-{self.name}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.sha, self.size, self.records, self.first = hashlib.sha256(), 0, 0, page_id
        info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_uri(self.name, "info")),
                       ("WARC-Date", WARC_DATE), ("WARC-Filename", self.name),
                       ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.put(info)

    def put(self, data: bytes):
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def write(self, page_id, data: bytes):
        if self.out is None:
            self.open(page_id)
        self.put(data)
        self.records += 1
        self.last = page_id
        if self.size >= self.file_bytes:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None
            self.commit(self.temporary, f"{self.root}/data/{self.name}")
            self.rows.append({"file": self.name, "bytes": self.size, "sha256": self.sha.hexdigest(),
                              "records": self.records, "first_id": self.first, "last_id": self.last})


def _key(id_col: str = "id"):
    """Ordering of records; a null id sorts first."""
    return F.struct(F.col(id_col).isNotNull().cast("int").alias("k"), F.coalesce(F.col(id_col), F.lit(0)).alias("i"),
                    F.col("digest").alias("d"))


def shard_starts(keyed: DataFrame, shard_bytes: int) -> list:
    """The first key of each shard, in order: a shard begins with the first
    record before which the payloads have passed another ``shard_bytes``."""
    rows = keyed.select(_key().alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")) \
        .select(F.col("key.k").alias("k"), F.col("key.i").alias("i"), F.col("key.d").alias("d"), "n")
    order = ["k", "i", "d"]
    before = running(ordered_parts(rows, [], order), [], order, {"before": ("sum", "n")})
    shard = F.floor(F.coalesce(F.col("before"), F.lit(0)) / F.lit(shard_bytes))
    first = before.groupBy(shard.alias("s")).agg(F.min(F.struct(*order)).alias("key")).orderBy("s")
    return [tuple(r["key"]) for r in first.collect()]


def shard_of(starts: list):
    """The number of the shard of a record: the last start at or before its
    key, found in blocks of about the square root of their number."""
    size = max(1, math.isqrt(len(starts)))
    parts = [starts[at:at + size] for at in range(0, len(starts), size)]
    kind = "struct<k: int, i: bigint, d: string>"

    def table(value, ddl):
        return F.from_json(F.lit(json.dumps(value)), ddl)

    def of(keys):
        return [{"k": k, "i": i, "d": d} for k, i, d in keys]
    key = _key()
    block = F.size(F.filter(table(of(p[0] for p in parts), f"array<{kind}>"), lambda x: x <= key))
    fine = F.element_at(table([of(p) for p in parts], f"array<array<{kind}>>"), F.greatest(block, F.lit(1)))
    return ((F.greatest(block, F.lit(1)) - 1) * size + F.size(F.filter(fine, lambda x: x <= key)) - 1).cast("int")


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` under the folder URI ``root`` (``data/``, ``manifest/``)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload.cast("binary")).alias("digest"),
                         F.octet_length(payload).cast("long").alias("n"))
    starts = shard_starts(keyed, shard_bytes)
    if not starts:
        spark = pages.sparkSession
        spark.createDataFrame([], MANIFEST).write.parquet(f"{root}/manifest")
        return
    # smallest id of each digest that occurs again; a null id is smaller than any
    again = keyed.where(F.col("n") >= min_bytes).groupBy("digest") \
        .agg(F.count("*").alias("c"), F.count("id").alias("with_id"), F.min("id").alias("least")) \
        .where("c > 1").select("digest", F.when(F.col("c") == F.col("with_id"), F.col("least")).alias("least"),
                               F.lit(True).alias("again"))
    again = again.checkpoint()
    records = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit(""))
                           .alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    small = again.count() <= BROADCAST_ROWS
    records = records.join(F.broadcast(again) if small else again, "digest", "left")
    placed = records.withColumn("shard", shard_of(starts)).repartitionByRange(len(starts), "shard") \
        .sortWithinPartitions("shard", "id", "digest", "url")

    ddl = StructType.fromDDL(MANIFEST)

    def write(batches):
        attempt = TaskContext.get().taskAttemptId()
        schema = to_arrow_schema(ddl)
        out, last, nth = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.shard != row["shard"]:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pylist(out.rows, schema=schema)
                    out, last = ShardWriter(root, row["shard"], attempt, file_bytes), None
                nth = nth + 1 if last == (row["id"], row["digest"]) else 0
                last = (row["id"], row["digest"])
                is_revisit = bool(row["again"]) and (row["id"] != row["least"] or nth > 0)
                url = row["url"] or f"urn:page:{row['id']}"
                out.write(row["id"], page_record(row["id"], url, row["html"].encode("utf-8"), row["least"],
                                                 is_revisit, nth))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(out.rows, schema=schema)
    placed.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")


#: Compressed bytes that the reader hands to the decompressor at a time.
FEED = 1 << 16


def members(data: bytes):
    """The gzip members of a file, decompressed one by one."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            fed = view[at:at + FEED]
            out.append(z.decompress(fed))
            at += len(fed) - len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes):
    """(headers, block) of each record of a WARC file; digests are checked."""
    for record in members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[:int(headers["Content-Length"])]
        if rest[len(block):] != b"\r\n\r\n":
            raise ValueError(f"record of wrong length: {headers.get('WARC-Record-ID')}")
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest differs: {headers.get('WARC-Record-ID')}")
        yield headers, block


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """The reader's row of a response or revisit record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload differs: {headers['WARC-Record-ID']}")
    ids = [headers.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
    return {"page_id": ids[0] and int(ids[0]), "payload_bytes": length, "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": ids[1] and int(ids[1])}


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """One row per page record of the files that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(f"{root}/data") \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    named = files.join(manifest.select("file", "sha256"), "file") if manifest.count() > BROADCAST_ROWS else \
        files.join(F.broadcast(manifest.select("file", "sha256")), "file")

    ddl = StructType.fromDDL(RECORDS)

    def read(batches):
        schema = to_arrow_schema(ddl)
        for batch in batches:
            for content, sha in zip(batch.column("content"), batch.column("sha256")):
                data = content.as_py()
                if hashlib.sha256(data).hexdigest() != sha.as_py():
                    raise ValueError("a file differs from the manifest")
                rows = [page_of(h, b) for h, b in parse(data) if h["WARC-Type"] != "warcinfo"]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return named.select("content", "sha256").mapInArrow(read, RECORDS)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, the default one where it names none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.makeQualified(p).toString()
    return f"file://{out[5:]}" if out.startswith("file:/") and not out.startswith("file://") else out


def oracle_sql() -> str:
    """DuckDB SQL for the round trip of ``pages`` (unique, non-null ids)."""
    letters = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1)) + "234567"
    base32 = " || ".join(f"substr('{letters}', ((('0x' || substr(h, {5 * j + 1}, 5))::BIGINT >> {sh}) & 31)::INTEGER + 1, 1)"
                         for j in range(8) for sh in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {base32} AS payload_digest,
  min(page_id) OVER (PARTITION BY body) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM q"""


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder of the shared checkpoint place and
    read the archives back."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    bounded_batches(spark)
    root = qualified(spark, scratch(spark, "warc"))
    write_warc(pages, root, **options)
    return read_warc(spark, root)
