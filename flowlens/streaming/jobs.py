"""Streaming jobs: packet files in, flow features / decisions / rules out.

* ``stage_packet_files`` lays a packets DataFrame down as a sequence of
  Parquet files in arrival (id) order — the file source then replays them
  one file per micro-batch, so state crosses batch boundaries (ST5).
* ``flow_feature_stream`` runs source -> state operator -> feature
  projection -> Parquet sink (ST1-ST3).
* ``decision_sink`` is the ``foreachBatch`` scorer: features -> votes ->
  strict-majority decision -> flow-log append + rule append (ST4, K6, R1).
  A model that fails on the rows of a micro-batch is found and left out of
  that batch (predictions -1, ACCEPT); the job goes on.
* ``packet_intake`` reads packet records as a stream and writes the good ones
  and, with their raw text, the malformed ones to two tables (S10).
* ``LateRows`` counts the rows dropped behind the watermark, exactly.

Sinks are exactly-once: the file sink and the foreachBatch writer both key
their output by batch id under the query's checkpoint location, which must
be on the shared file system (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import time
import uuid
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowlens.functions import packets as PK
from flowlens.functions import votes as V
from flowlens.operators import features as feat
from flowlens.operators import rules as R
from flowlens.operators.models import ModelVotes
from flowlens.operators.segment import KEY5
from flowlens.session import checkpoint_dir
from flowlens.streaming.flow_state import assemble_flows


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "jobs", f"{name}-{uuid.uuid4().hex[:12]}")


#: Packets of a staged file (some tens of bytes each).
STAGE_ROWS = 1_000_000


def stage_packet_files(packets: DataFrame, folder: str, n_files: int | None = None, order_col: str = "id",
                       rows: int = STAGE_ROWS) -> str:
    """Write ``packets`` as files of id ranges in one parallel pass, and give
    the files rising modification times, by which the file source orders them:
    file order = arrival order.  ``n_files`` at least (4 by default), and as
    many as hold about ``rows`` packets each.  A replay/staging helper."""
    n = packets.count()
    if not n:
        packets.limit(0).write.mode("append").parquet(folder)
        return folder
    parts = max(n_files or 4, -(-n // rows))
    packets.repartitionByRange(parts, order_col).sortWithinPartitions(order_col).write.mode("append").parquet(folder)
    order_by_name(packets.sparkSession, folder)
    return folder


def order_by_name(spark: SparkSession, folder: str) -> None:
    """Give the part files of a folder modification times in name order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    now = int(time.time()) * 1000
    for i, p in enumerate(parts):
        fs.setTimes(p, now - 1000 * (len(parts) - i), -1)


def packet_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
                 .parquet(folder))


def run_available(df_stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything available (in several micro-batches), then stop."""
    q = (df_stream.writeStream.format(fmt).option("path", sink)
                  .option("checkpointLocation", checkpoint).outputMode("append")
                  .trigger(availableNow=True).start())
    q.awaitTermination()


def flow_feature_stream(stream: DataFrame, timeout_s: float, keep: Sequence[str] = (*KEY5, "seg_no", "close_id", "label"),
                        **kw) -> DataFrame:
    flows = assemble_flows(stream, timeout_s, **kw)
    return feat.flow_features_78(flows, keep=keep)


def stand_in_votes(feats: DataFrame) -> DataFrame:
    """Threshold stand-ins for the three models (the flagship's rule)."""
    return feats.withColumns({
        "pred_rf": (F.col("f4") > 400).cast("int"),
        "pred_lr": (F.col("f43") > 0).cast("int"),
        "pred_mlp": (F.col("f16") < 3600).cast("int"),
    })


def decision_sink(log_path: str, rules_path: str, models: Callable[[DataFrame], DataFrame] = stand_in_votes,
                  names: Sequence[str] = ("rf", "lr", "mlp"), ttl_s: int = R.LIVE_TTL_S):
    """ST4: foreachBatch function scoring closed flows and appending the
    flow log and the block rules of that micro-batch (idempotent per batch
    id: a replayed batch overwrites its own partition).

    ``models`` may be a ``ModelVotes``: should the batch fail, each of its
    models runs alone over the batch, and those that fail are left out of it.
    Any other failure ends the job."""
    def write(batch: DataFrame, batch_id: int, vote) -> None:
        cols = [f"pred_{n}" for n in names]
        dec = vote(batch).select(
            F.col("close_id").alias("id"), F.col("end_us").alias("timestamp_us"), *KEY5,
            F.to_json(V.predictions_map(list(names), cols)).alias("prediction"),
            V.majority_decision(cols).alias("decision")).withColumn("batch_id", F.lit(batch_id)).persist()
        try:
            (dec.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(log_path))
            sourced = dec.where(PK.is_valid_ipv4("src_ip") | PK.is_valid_ipv6("src_ip"))
            rules = R.block_rules(sourced, ttl_s, id_col="id", ts_col="timestamp_us").withColumn("batch_id", F.lit(batch_id))
            (rules.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                  .partitionBy("batch_id").parquet(rules_path))
        finally:
            dec.unpersist()

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state runs once, however often the batch is read
        try:
            if not batch.count():  # one pass over all of the state; no folders for idle triggers
                return
            write(batch, batch_id, models)
        except Exception:  # noqa: BLE001 - whatever a model raised in a task
            failed = models.failing(batch) if isinstance(models, ModelVotes) else set()
            if not failed:
                raise
            print(f"batch {batch_id}: models {sorted(failed)} failed")
            write(batch, batch_id, models.without(failed))
        finally:
            batch.unpersist()
    return fn


class LateRows(StreamingQueryListener):
    """Packets dropped behind the watermark, per query, over all its
    micro-batches (a query's own progress list keeps the last 100 only)."""

    def __init__(self):
        self.batches: dict[str, dict[int, int]] = {}

    def note(self, query_id: str, progress) -> None:
        n = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        seen = self.batches.setdefault(query_id, {})
        seen[progress.batchId] = max(n, seen.get(progress.batchId, 0))

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.id), {})

    def onQueryProgress(self, event) -> None:
        self.note(str(event.progress.id), event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query) -> int:
        """All rows that ``query`` has dropped; its latest progress, which may
        not have reached the listener yet, is taken from the query itself."""
        for p in query.recentProgress:
            self.note(str(query.id), p)
        return sum(self.batches.get(str(query.id), {}).values())


_LATE: dict[str, LateRows] = {}


def late_listener(spark: SparkSession) -> LateRows:
    """The listener of this application; add it before a query starts."""
    app = spark.sparkContext.applicationId
    if app not in _LATE:
        _LATE[app] = LateRows()
        spark.streams.addListener(_LATE[app])
    return _LATE[app]


def late_rows(query) -> int:
    """Packets that the query has dropped behind the watermark since the
    application counts them (``late_listener``; ``start_live`` does)."""
    return late_listener(SparkSession.getActiveSession()).total(query)


def packet_intake(spark: SparkSession, folder: str, out: str, schema, fmt: str = "json", files_per_batch: int = 1000):
    """S10 as a stream: text records arriving in ``folder`` -> the table
    ``out``/packets and, for malformed ones, ``out``/malformed (file, raw text),
    both keyed by batch id, so a replayed batch overwrites its own rows.  Each
    micro-batch is read once; its counts are observed as ``intake`` (rows,
    malformed) in the query's progress.  Returns the writer to be started."""
    from flowlens.sources.io import parsed_records
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder) \
        .withColumn("file", F.col("_metadata.file_name"))
    rows = parsed_records(lines, schema, fmt).observe(
        "intake", F.count(F.lit(1)).alias("rows"), F.count_if("malformed").alias("malformed"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        try:
            for name, part in (("packets", batch.where("NOT malformed").select("record.*", "batch_id")),
                               ("malformed", batch.where("malformed").select("file", "raw", "batch_id"))):
                part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                    .partitionBy("batch_id").parquet(f"{out}/{name}")
        finally:
            batch.unpersist()
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", out + "/_checkpoint")


def start_live(spark: SparkSession, packet_dir: str, out_dir: str, timeout_s: float = 5.0,
               trigger: str = "200 milliseconds", idle_timeout_s: float | None = 600.0, emit_idle: bool = True,
               models: dict | None = None, watermark: str = "1 hour", schema=None):
    """ST1-ST6 as a service: packet files arriving in ``packet_dir`` ->
    stateful flow assembly (live timeout, 5 s) -> features -> votes ->
    decisions appended to ``out_dir``/flow_log and rules to ``out_dir``/rules
    every ``trigger``.

    ``models`` (name -> fitted or loaded ``PipelineModel``) give the votes,
    with the failure rule; without them the threshold stand-ins do.  A flow
    without packets for ``idle_timeout_s`` of event time is scored as it is
    (or, without ``emit_idle``, dropped) and its state goes; a closed flow's
    state goes at once, so state is bounded by the open flows.  Flow numbers
    begin anew with a key's state: ``close_id`` identifies a flow.  Rows
    behind the watermark are dropped and counted (``late_rows``, exactly).  Returns
    the running StreamingQuery."""
    from flowlens.sources.io import PACKETS
    stream = packet_stream(spark, packet_dir, schema or PACKETS, files_per_batch=1000)
    feats = flow_feature_stream(stream, timeout_s, keep=[*KEY5, "seg_no", "close_id", "end_us"],
                                idle_timeout_s=idle_timeout_s, emit_idle=emit_idle, watermark=watermark,
                                drop_closed=True)
    votes, names = stand_in_votes, ("rf", "lr", "mlp")
    if models:
        votes, names = ModelVotes(models), tuple(models)
    late_listener(spark)
    sink = decision_sink(out_dir + "/flow_log", out_dir + "/rules", votes, names)
    return (feats.writeStream.foreachBatch(sink).option("checkpointLocation", out_dir + "/_checkpoint")
                 .trigger(processingTime=trigger).start())
