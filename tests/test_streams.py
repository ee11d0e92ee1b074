"""Streaming jobs: intake with quarantine, run-time model failures, exact late
counts, idle flows, compaction of batch tables, chunk probes."""

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import features as feat
from flowlens.operators import models as MD
from flowlens.operators.segment import KEY5
from flowlens.sources import batches as BT
from flowlens.sources import io as IO
from flowlens.streaming import jobs as J
from flowlens.streaming.flow_state import assemble_flows

SMOKE = "/root/testdata/sf0.001"
PACKET = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, id long, ts_us long, " \
         "length int, tcp_flags int, label string"


def plain_flows(rows, t, idle):
    """Per key: a flow ends by a packet after start + t, or before a packet
    that comes after a silence; what is open at the end is left out."""
    out, state = [], {}
    for ip, i, ts in rows:
        st = state.get(ip)
        if st and ts - st["prev"] > idle:
            out.append((ip, st["ids"][0], st["ids"][-1], False))
            st = None
        if st is None:
            st = state[ip] = {"start": ts, "ids": [], "prev": ts}
        st["ids"].append(i)
        st["prev"] = ts
        if ts - st["start"] > t:
            out.append((ip, st["ids"][0], st["ids"][-1], True))
            del state[ip]
    return out, state


@pytest.mark.parametrize("n_files", [1, 5])
def test_idle_flows_do_not_depend_on_batches(spark, n_files):
    r = random.Random(3)
    ts, rows = 1_700_000_000_000_000, []
    for i in range(400):
        ts += r.choice([1, 2, 5]) * 10**6 if r.random() < 0.97 else 60 * 10**6
        rows.append((r.choice("aabc"), i, ts))
    df = spark.createDataFrame([(ip, "x", 1, 2, 6, i, t, 50, 0, "B") for ip, i, t in rows], PACKET)
    folder = J.stage_packet_files(df, J.scratch(spark, "idle-in"), n_files=n_files, rows=400 // n_files + 1)
    flows = assemble_flows(J.packet_stream(spark, folder, df.schema), 40, idle_timeout_s=20, emit_idle=True,
                           watermark="0 seconds", drop_closed=True)
    sink = J.scratch(spark, "idle-out")
    J.run_available(flows.select("src_ip", "first_id", "close_id", "closed"), sink, sink + "-ckpt")
    want, left = plain_flows(rows, 40 * 10**6, 20 * 10**6)
    want += [(ip, s["ids"][0], s["ids"][-1], False) for ip, s in left.items() if s["prev"] // 1000 + 20_001 <= ts // 1000]
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == sorted(want)
    assert any(not c for *_, c in want) and any(c for *_, c in want)


def test_intake_quarantines_malformed_records(spark, tmp):
    folder, out = os.path.join(tmp, "in"), os.path.join(tmp, "out")
    os.makedirs(folder)
    for f in range(3):
        with open(os.path.join(folder, f"{f}.json"), "w") as h:
            for i in range(10):
                h.write("broken {\n" if i == f else json.dumps({"id": 10 * f + i, "ts_us": i, "length": 1}) + "\n")
    schema = T.StructType.fromDDL("id long, ts_us long, length int")
    for _ in range(2):  # a restarted query adds nothing
        q = J.packet_intake(spark, folder, out, schema, files_per_batch=1).trigger(availableNow=True).start()
        q.awaitTermination()
    counts = spark.read.parquet(out + "/packets")
    assert sorted(r["id"] for r in counts.collect()) == [10 * f + i for f in range(3) for i in range(10) if i != f]
    bad = spark.read.parquet(out + "/malformed").collect()
    assert sorted((r["file"], r["raw"]) for r in bad) == [(f"{f}.json", "broken {") for f in range(3)]


def test_intake_counts_are_observed(spark, tmp):
    folder = os.path.join(tmp, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, "a.json"), "w") as h:
        h.write('{"id": 1}\n{"id": 2}\nno\n')
    q = J.packet_intake(spark, folder, os.path.join(tmp, "out"), T.StructType.fromDDL("id long")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p.observedMetrics["intake"] for p in q.recentProgress if "intake" in p.observedMetrics]
    assert sum(s["rows"] for s in seen) == 3 and sum(s["malformed"] for s in seen) == 1


class _FailsOnRows:
    """A model whose plan is fine and whose tasks fail."""

    stages: list = []

    def transform(self, df):
        bad = F.udf(lambda x: 1 // 0, "double")(F.col("f4"))
        return df.withColumns({"prediction": bad, "probability": F.lit(None), "rawPrediction": F.lit(None)})


def test_model_failing_at_run_time_is_left_out_of_the_batch(spark, monkeypatch):
    feats = feat.flow_features_78(feat.packet_flows(__import__("flowlens.sources.fixtures", fromlist=["packets"])
                                                    .packets(spark, SMOKE), 21600),
                                  keep=[*KEY5, "seg_no", "close_id", "end_us"])
    monkeypatch.setattr(MD, "score", lambda model, df, name: model.transform(df).withColumn(
        f"pred_{name}", F.col("prediction").cast("int")))

    class One(_FailsOnRows):
        def transform(self, df):
            return df.withColumn("prediction", F.lit(1.0))
    base = J.scratch(spark, "rt")
    votes = MD.ModelVotes({"good": One(), "bad": _FailsOnRows()})
    assert votes.failing(feats) == {"bad"}
    J.decision_sink(base + "/log", base + "/rules", votes, ("good", "bad"))(feats, 7)
    log = spark.read.parquet(base + "/log").collect()
    assert len(log) == 450 and {r["decision"] for r in log} == {"ACCEPT"}
    assert {r["prediction"] for r in log} == {'{"good":-1,"bad":-1}'}
    with pytest.raises(Exception):  # no model to blame: the job ends
        J.decision_sink(base + "/log", base + "/rules", votes.without({"bad", "good"}), ("absent",))(feats, 8)


def test_late_rows_are_counted_over_all_batches(spark):
    """More micro-batches than a query remembers; each brings one late row."""
    J.late_listener(spark)
    folder = J.scratch(spark, "late-in")
    s, t0, rows = 10**6, 1_700_000_000_000_000, []
    n = 110
    for i in range(n):
        rows.append(("a", "x", 1, 2, 6, 2 * i, t0 + i * 100 * s, 50, 0, "B"))
        rows.append(("b", "x", 1, 2, 6, 2 * i + 1, t0 - 1000 * s if i > 1 else t0 + i * 100 * s, 50, 0, "B"))
    df = spark.createDataFrame(rows, PACKET)
    J.stage_packet_files(df, folder, n_files=n)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        flows = assemble_flows(J.packet_stream(spark, folder, df.schema), 10**6, idle_timeout_s=10**6, watermark="1 second")
        q = flows.writeStream.format("noop").option("checkpointLocation", J.scratch(spark, "late-ckpt")) \
            .outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    late = sum(1 for r in rows if r[6] < t0)
    assert J.late_rows(q) in (late, late - 1)   # the first late file may share a batch with the watermark's first
    assert sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators) < J.late_rows(q)


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def put(spark, table, batch, ids):
    spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA).withColumn("batch_id", F.lit(batch)) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table)


def test_compaction_keeps_one_version(spark, tmp):
    table = os.path.join(tmp, "log")
    assert BT.read(spark, table, SCHEMA).count() == 0 and not BT.compact(spark, table, SCHEMA, 5)
    for b in range(6):
        put(spark, table, b, [10 * b, 10 * b + 1])
    ids = lambda: sorted(r["id"] for r in BT.read(spark, table, SCHEMA).collect())
    every = sorted(10 * b + k for b in range(6) for k in (0, 1))
    assert ids() == every and BT.small_folders(spark, table) == 6
    assert BT.compact(spark, table, SCHEMA, 3)
    assert ids() == every and BT.small_folders(spark, table) == 2
    put(spark, table, 3, [30, 31])                        # a replayed batch changes nothing
    assert ids() == every
    put(spark, table, 6, [60])
    assert BT.compact(spark, table, SCHEMA, 6) and BT.small_folders(spark, table) == 0
    assert ids() == every + [60]
    assert sorted({r["batch_id"] for r in BT.read(spark, table, SCHEMA).collect()}) == list(range(7))
    gone = BT.vacuum(spark, table)
    assert sorted(gone) == [f"batch_id={b}" for b in range(4)] and ids() == every + [60]
    # two compactions of one version: the second is told to try again
    folder = BT._Folder(spark, table)
    version = folder.versions()[-1]
    assert folder.commit(version + 1, folder.manifest(version)) and not folder.commit(version + 1, {})
    assert ids() == every + [60]


def test_chunk_probe_tells_empty_from_broken(spark, tmp):
    for name, rows in (("a/p.parquet", [1, 2]), ("b/p.parquet", []), ("c/p.parquet", [3])):
        os.makedirs(os.path.join(tmp, os.path.dirname(name)))
        pq.write_table(pa.table({"x": pa.array(rows, pa.int64())}), os.path.join(tmp, name))
    os.makedirs(os.path.join(tmp, "d"))
    with open(os.path.join(tmp, "d/p.parquet"), "wb") as f:
        f.write(b"PAR1 this is no chunk")
    rows, left = IO.read_chunks(spark, tmp + "/*", skip_corrupt=True)
    assert sorted(r["x"] for r in rows.collect()) == [1, 2, 3]
    found = left.collect()
    assert len(found) == 1 and found[0]["path"].endswith("d/p.parquet") and "ArrowInvalid" in found[0]["reason"]
