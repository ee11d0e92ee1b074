"""Helpers shared by the operators: Arrow mapping, shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.session import checkpoint_dir

#: Text bytes that a Python worker turns into objects at a time.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col) -> "F.Column":
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def give_back() -> None:
    """Return freed memory to the system: a Python worker serves many tasks of
    many queries, and would keep the largest size it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES):
    """Parts of a batch of about ``limit`` bytes, at least one row each."""
    n = batch.num_rows
    if n:
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))
        give_back()


def map_columns(df: DataFrame, fn, schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` of ``fn(dict of lists) -> dict of lists``, by slices of
    about ``limit`` bytes."""
    ddl = StructType.fromDDL(schema)
    bounded_batches(df.sparkSession)

    def run(batches):
        out = to_arrow_schema(ddl)
        for batch in batches:
            for part in slices(batch, limit):
                yield pa.RecordBatch.from_pydict(fn(part.to_pydict()), schema=out)
    return df.mapInArrow(run, ddl)


def tokenizer_path(tokenizer: str) -> str:
    """A vocabulary file: a path, or the name of a public one where this
    process runs."""
    if os.path.isabs(tokenizer):
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch where the session has no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared checkpoint folder; the session's
    end removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and
    survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
