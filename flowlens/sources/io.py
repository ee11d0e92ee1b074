"""Readers, writers and table schemas.

CSV comes in once and is written out as Parquet; everything downstream
reads Parquet (column pruning, predicate pushdown, splittable files).
Schemas are inferred once from the header and then frozen.
"""

from __future__ import annotations

import secrets
import time
from typing import Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.clean import find_label_column, strip_headers
from flowlens.session import reliable_checkpoint

# ---------------------------------------------------------------- schemas (K8)

PACKETS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts_us", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.IntegerType(), True),
    T.StructField("length", T.IntegerType(), False),
    T.StructField("tcp_flags", T.IntegerType(), True),
])

FLOW_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp_us", T.LongType(), True),
    T.StructField("src_ip", T.StringType(), True),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.IntegerType(), True),
    T.StructField("prediction", T.StringType(), True),
    T.StructField("decision", T.StringType(), True),
])

BLOCK_RULES = T.StructType([
    T.StructField("rule_id", T.LongType(), False),
    T.StructField("added_at_us", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), True),
    T.StructField("src_port", T.IntegerType(), True),
    T.StructField("dst_port", T.IntegerType(), True),
    T.StructField("protocol", T.IntegerType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("expiry_us", T.LongType(), True),
    T.StructField("reason", T.StringType(), True),
])

RUN_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("script", T.StringType(), True),
    T.StructField("n_rows", T.IntegerType(), True),
    T.StructField("models_used", T.StringType(), True),
    T.StructField("ensemble_used", T.IntegerType(), True),
    T.StructField("accuracy", T.DoubleType(), True),
    T.StructField("f1_score", T.DoubleType(), True),
    T.StructField("notes", T.StringType(), True),
])

EPOCH_LOG = T.StructType([
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("loss", T.DoubleType(), True),
    T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("epoch_time", T.DoubleType(), True),
])

TABLES = {"packets": PACKETS, "flow_logs": FLOW_LOG, "block_rules": BLOCK_RULES,
          "logs": RUN_LOG, "epochs": EPOCH_LOG}


def create_tables(spark: SparkSession, root: str, names: Sequence[str] = tuple(TABLES)) -> dict[str, str]:
    """K8: create the empty Parquet tables under ``root`` if absent."""
    paths = {}
    for n in names:
        p = f"{root.rstrip('/')}/{n}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            spark.createDataFrame([], TABLES[n]).write.mode("append").parquet(p)
        paths[n] = p
    return paths


# ---------------------------------------------------------------- readers

def read_csv_dir(spark: SparkSession, path: str, glob: str | None = None, schema: T.StructType | None = None,
                 with_file: bool = True) -> DataFrame:
    """Every CSV of a folder (optionally only ``glob`` names), header
    row, blanks stripped from names, source file kept as ``source_file``.
    Without ``schema`` the schema is inferred once from the files."""
    r = spark.read.option("header", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    df = r.csv(path)
    if with_file:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    return strip_headers(df)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header only (no data scan)."""
    return [c.strip() for c in spark.read.option("header", True).csv(path).columns]


def label_column_of(spark: SparkSession, path: str) -> str:
    """S4 + P2: the label column of a CSV folder, or an error."""
    return find_label_column(header_columns(spark, path), exact_first=False)


def parsed_records(lines: DataFrame, schema: T.StructType = PACKETS, fmt: str = "json") -> DataFrame:
    """Text lines (``value``; batch or stream) -> ``record`` (the fields of
    ``schema``), ``malformed``, ``raw`` and the other columns.  Lines are parsed
    with ``from_json``/``from_csv`` in PERMISSIVE mode: a malformed one does not
    fail the job."""
    bad = "_corrupt_record"
    full = T.StructType(list(schema.fields) + [T.StructField(bad, T.StringType(), True)])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parse = F.from_json if fmt == "json" else F.from_csv
    parsed = lines.withColumn("_r", parse(F.col("value"), full if fmt == "json" else full.simpleString(), opts))
    return parsed.select(F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema]).alias("record"),
                         F.col(f"_r.{bad}").isNotNull().alias("malformed"), F.col("value").alias("raw"),
                         *[c for c in lines.columns if c != "value"])


def read_packet_records(spark: SparkSession, path: str, schema: T.StructType = PACKETS,
                        fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Packet records (JSON or CSV lines) with a fixed schema: the good
    rows, and the malformed ones with their raw text (the notice).  Either side
    is one plain scan (no cache of the input); ``streaming.jobs.packet_intake``
    writes both from one."""
    rec = parsed_records(spark.read.text(path), schema, fmt)
    return rec.where("NOT malformed").select("record.*"), rec.where("malformed").select(F.col("raw").alias("_corrupt_record"))


def read_chunks(spark: SparkSession, path: str, skip_corrupt: bool = False):
    """Every normalised chunk file at once.  A corrupt file fails the
    job; with ``skip_corrupt`` it is left out and the result is (rows, table of
    the files left out: ``path``, ``reason``).

    A scan without columns reads footers only and gives the files that have
    rows.  The others, few, are empty or broken: their bytes are probed, one
    small task each, and the broken ones are told with the reason.  Files are
    known by their whole path."""
    if not skip_corrupt:
        return spark.read.parquet(path)
    rows = spark.read.options(ignoreCorruptFiles=True, mergeSchema=True).parquet(path)  # any readable footer
    whole = rows.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True) \
        .load(path)
    named = F.regexp_replace(F.col("path"), "^([a-z0-9]+):/+", "$1:/")
    missing = files.select("path").withColumn("_p", named).join(
        whole.select(named.alias("_p")), "_p", "left_anti").select("path").collect()  # one name per unread file
    probe = "path string, reason string"
    if not missing:
        return rows, spark.createDataFrame([], probe)

    def look(frames):
        import io as bytes_io

        import pandas as pd
        import pyarrow.parquet as pq
        for pdf in frames:
            found = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    pq.ParquetFile(bytes_io.BytesIO(content))
                except Exception as e:  # noqa: BLE001 - any failure is the reason
                    found.append((name, f"{type(e).__name__}: {e}"[:200]))
            if found:
                yield pd.DataFrame(found, columns=["path", "reason"])
    left = spark.read.format("binaryFile").load([r["path"] for r in missing]).select("path", "content")
    return rows, reliable_checkpoint(left.mapInPandas(look, probe))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a split-partitioned dataset (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_labels_if_valid(spark: SparkSession, path: str, expected_rows: int) -> DataFrame | None:
    """An optional label table; missing, unreadable or of the wrong size
    -> None (the caller then skips the metrics)."""
    try:
        y = spark.read.parquet(path)
        n = y.count()
    except (AnalysisException, PySparkException) as e:  # no such path, no readable footer, no schema
        print(f"labels of {path} not used: {type(e).__name__}")
        return None
    return y if n == expected_rows else None


# ---------------------------------------------------------------- writers

def write_clean(df: DataFrame, path: str, by: str = "source_file", scaler: DataFrame | None = None) -> None:
    """K1/K3: one output folder per input file, Parquet; for normalised rows
    the scaler's row goes to ``<path>_scaler``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    if scaler is not None:
        scaler.write.mode("overwrite").parquet(path.rstrip("/") + "_scaler")


def write_splits(df: DataFrame, path: str, scaler: DataFrame | None = None) -> None:
    """K2: train/test rows partitioned by ``split``; the fitted scaler's row,
    where given, goes to the table beside them (``<path>_scaler``)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    if scaler is not None:
        scaler.write.mode("overwrite").parquet(path.rstrip("/") + "_scaler")


def write_predictions_csv(df: DataFrame, path: str) -> DataFrame:
    """K4: predictions as CSV with header; returns the first 10 rows' plan."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.limit(10)


def write_observed(df: DataFrame, path: str, name: str = "write_stats", mode: str = "overwrite") -> dict:
    """Row count (and label balance when a ``Label`` column exists)
    collected during the write itself via ``observe`` (no second scan)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    if "Label" in df.columns:
        metrics.append(F.count_if(F.col("Label") == "BENIGN").alias("benign"))
    df.observe(obs, *metrics).write.mode(mode).parquet(path)
    return obs.get


def parse_timestamp_column(df: DataFrame, col: str = "Timestamp", out: str = "ts_us") -> DataFrame:
    """A CSV timestamp given as epoch seconds *or* as date text ->
    microseconds (LONG); unparsable values become NULL (count them with
    ``where(out IS NULL)`` instead of failing the job)."""
    c = F.col(f"`{col}`").cast("string")
    as_num = c.try_cast("double")
    as_text = F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy H:mm:ss")),
                         F.try_to_timestamp(c, F.lit("d/M/yyyy H:mm")),
                         F.try_to_timestamp(c))
    micros = F.when(as_num.isNotNull(), (as_num * 1_000_000).cast("long")) \
              .otherwise(F.unix_micros(as_text))
    return df.withColumn(out, micros)


def append(df: DataFrame, path: str) -> None:
    """K5-K7, K9: append rows to a table."""
    df.write.mode("append").parquet(path)


def log_run(spark: SparkSession, path: str, run: dict) -> int:
    """K7: append one run-log row (``run``: the fields of ``RUN_LOG`` but id
    and timestamp) and return its id: microseconds since 1970 and 10 random
    bits, so concurrent runs need no shared counter and ids rise with time."""
    unknown = set(run) - set(RUN_LOG.fieldNames())
    if unknown:
        raise ValueError(f"not in the run log: {sorted(unknown)}")
    new_id = (time.time_ns() // 1000) << 10 | secrets.randbits(10)
    row = [tuple({**run, "id": new_id}.get(f) for f in RUN_LOG.fieldNames())]
    append(spark.createDataFrame(row, RUN_LOG).withColumn("timestamp", F.current_timestamp()), path)
    return new_id
