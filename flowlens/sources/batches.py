"""Tables that streaming jobs append to by micro-batch: one version to read,
and compaction of their many small folders (K5, K6).

A job writes each micro-batch to ``<table>/batch_id=N`` (an overwrite, so a
replayed batch is the same batch).  ``compact`` copies the batches up to a
given one into a few large files under ``<table>/_compacted`` and then commits
a manifest, ``<table>/_manifests/<version>``: the folders of compacted rows, and
the last batch they hold.  A manifest becomes visible by one rename to a
version that nobody else has taken, so of two compactions one is told to try
again.  ``read`` takes the newest manifest: its compacted files, and the batch
folders after its last batch.  A batch that is replayed after its compaction
changes nothing, since a reader no longer looks at its folder.  ``vacuum``
deletes batch folders that the manifest before the newest covers already, so
readers of the newest two versions are not disturbed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a compacted file, about.
FILE_BYTES = 128 << 20


class _Folder:
    """A table folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm = spark.sparkContext._jvm
        self.root = table.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def batches(self) -> list[int]:
        return sorted(int(n.split("=", 1)[1]) for n in self.names("") if n.startswith("batch_id="))

    def size(self, names: list[str]) -> int:
        return sum(self.fs.getContentSummary(self.path(n)).getLength() for n in names)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.names("_manifests") if n.isdigit())

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"_manifests/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, manifest: dict) -> bool:
        """Make a manifest visible; False where its version is taken."""
        temp = self.path(f"_manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        target = self.path(f"_manifests/{version}")
        done = not self.fs.exists(target) and self.fs.rename(temp, target)
        if not done:
            self.fs.delete(temp, False)
        return done


def _current(folder: _Folder) -> tuple[int, dict]:
    versions = folder.versions()
    return (versions[-1], folder.manifest(versions[-1])) if versions else (0, {"compacted": [], "through": -1})


def _paths(folder: _Folder, names: list[str]) -> list[str]:
    return [f"{folder.root}/{n}" for n in names]


def read(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows of one version of the table, with ``batch_id``; none where
    nothing has been written.  ``schema``: the columns without ``batch_id``."""
    folder = _Folder(spark, table)
    _, now = _current(folder)
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    parts = []
    if now["compacted"]:
        parts.append(spark.read.schema(full).parquet(*_paths(folder, now["compacted"])))
    new = [f"batch_id={b}" for b in folder.batches() if b > now["through"]]
    if new:
        parts.append(spark.read.schema(full).option("basePath", folder.root).parquet(*_paths(folder, new)))
    if not parts:
        return spark.createDataFrame([], full)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(spark: SparkSession, table: str, schema: T.StructType, through: int, file_bytes: int = FILE_BYTES) -> bool:
    """Compact the batches up to ``through`` (which must be complete: below
    the stream's running batch).  The files of earlier compactions stay as
    they are while they are large; small ones are taken along.  False: nothing
    to do, or another compaction was first."""
    folder = _Folder(spark, table)
    version, now = _current(folder)
    new = [f"batch_id={b}" for b in folder.batches() if now["through"] < b <= through]
    if not new:
        return False
    small = [c for c in now["compacted"] if folder.size([c]) < file_bytes // 2]
    keep = [c for c in now["compacted"] if c not in small]
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).option("basePath", folder.root).parquet(*_paths(folder, new))
    if small:
        rows = rows.unionByName(spark.read.schema(full).parquet(*_paths(folder, small)))
    files = max(1, -(-folder.size(new + small) // file_bytes))
    target = f"_compacted/{uuid.uuid4().hex}"
    rows.repartitionByRange(int(files), "batch_id").write.parquet(f"{folder.root}/{target}")
    return folder.commit(version + 1, {"compacted": [*keep, target], "through": int(through)})


def vacuum(spark: SparkSession, table: str) -> list[str]:
    """Delete what neither of the newest two versions reads; the names."""
    folder = _Folder(spark, table)
    versions = folder.versions()
    if len(versions) < 2:
        return []
    before, now = (folder.manifest(v) for v in versions[-2:])
    used = {*before["compacted"], *now["compacted"]}
    gone = [f"batch_id={b}" for b in folder.batches() if b <= before["through"]]
    gone += [f"_compacted/{n}" for n in folder.names("_compacted") if f"_compacted/{n}" not in used
             and any(f"_compacted/{n}" in folder.manifest(v)["compacted"] for v in versions[:-2])]
    for n in gone:
        folder.fs.delete(folder.path(n), True)
    return gone


def small_folders(spark: SparkSession, table: str) -> int:
    """Batch folders that a reader of the newest version has to open."""
    folder = _Folder(spark, table)
    return sum(b > _current(folder)[1]["through"] for b in folder.batches())
