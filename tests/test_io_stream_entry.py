"""Sources and sinks on temp dirs, stream replay = batch, entry contract."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import features as feat
from flowlens.sources import io as IO
from flowlens.streaming import jobs as J

SMOKE = "/root/testdata/sf0.001"


def _csv(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_csv_folder_glob_headers_label(spark, tmp):
    raw = os.path.join(tmp, "raw")
    _csv(raw, "a_clean.csv", " Destination Port, Flow Bytes/s, Label\n80,1.5,BENIGN\n443,inf,DDoS\n")
    _csv(raw, "b.csv", " Destination Port, Flow Bytes/s, Label\n53,2.0,BENIGN\n")
    df = IO.read_csv_dir(spark, raw, glob="*_clean.csv")
    assert "Destination Port" in df.columns and "Label" in df.columns
    assert df.count() == 2 and {r["source_file"] for r in df.collect()} == {"a_clean.csv"}
    assert IO.label_column_of(spark, raw) == "Label"
    assert IO.header_columns(spark, raw)[0] == "Destination Port"


def test_no_label_column_is_an_error(spark, tmp):
    raw = os.path.join(tmp, "nolabel")
    _csv(raw, "x.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        IO.label_column_of(spark, raw)


def test_chunks_tables_run_log(spark, tmp):
    df = spark.range(10).withColumn("source_file", (F.col("id") % 2).cast("string"))
    IO.write_clean(df, os.path.join(tmp, "chunks"))
    assert IO.read_chunks(spark, os.path.join(tmp, "chunks")).count() == 10
    paths = IO.create_tables(spark, os.path.join(tmp, "db"))
    assert spark.read.parquet(paths["block_rules"]).count() == 0
    first = IO.log_run(spark, paths["logs"], {"script": "train", "n_rows": 10, "models_used": "rf,lr",
                                              "ensemble_used": 1, "accuracy": 0.9, "f1_score": 0.8})
    second = IO.log_run(spark, paths["logs"], {"script": "predict", "n_rows": 5, "models_used": "rf", "ensemble_used": 0})
    assert first < second
    with pytest.raises(ValueError):
        IO.log_run(spark, paths["logs"], {"no_such_field": 1})
    logs = spark.read.parquet(paths["logs"]).orderBy("id").collect()
    assert [r["id"] for r in logs] == [first, second] and logs[0]["ensemble_used"] == 1
    assert IO.read_labels_if_valid(spark, os.path.join(tmp, "absent"), 3) is None


def test_corrupt_chunks_are_told(spark, tmp):
    spark.range(4).coalesce(1).write.parquet(os.path.join(tmp, "c"))
    with open(os.path.join(tmp, "c", "bad.parquet"), "wb") as f:
        f.write(b"not a parquet file at all")
    rows, skipped = IO.read_chunks(spark, os.path.join(tmp, "c"), skip_corrupt=True)
    assert rows.count() == 4 and [os.path.basename(r["path"]) for r in skipped.collect()] == ["bad.parquet"]
    with pytest.raises(Exception):
        IO.read_chunks(spark, os.path.join(tmp, "c")).count()


def test_scaler_tables_are_written(spark, tmp):
    df = spark.range(4).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    stats = spark.createDataFrame([(1.0, 2.0)], "id__mean double, id__std double")
    IO.write_splits(df, os.path.join(tmp, "s"), stats)
    assert IO.read_split(spark, os.path.join(tmp, "s"), "train").count() == 3
    assert spark.read.parquet(os.path.join(tmp, "s_scaler")).first()["id__std"] == 2.0


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace
    from flowlens.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_downcast_keeps_what_does_not_fit(spark):
    from flowlens.operators.clean import downcast
    df = spark.createDataFrame([(1, 2**31, 5, 0.5, "BENIGN"), (2, None, -7, 1.5, "DDoS")],
                               "row_id long, big long, small long, x double, Label string")
    types = dict(downcast(df, keep=("row_id",)).dtypes)
    assert types == {"row_id": "bigint", "big": "bigint", "small": "int", "x": "float", "Label": "tinyint"}
    assert downcast(df, keep=("row_id",)).agg(F.max("big")).first()[0] == 2**31


def test_failure_rule(spark):
    from flowlens.functions import votes as V
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 1, 0), (1, 1, None), (1, -1, 1), (0, 0, 1)], "a int, b int, c int")
    rows = df.select(V.majority_decision(cols).alias("d"), *[c.alias(n) for n, c in V.failure_rule(cols).items()]).collect()
    assert [r.d for r in rows] == ["DROP", "ACCEPT", "ACCEPT", "ACCEPT"]
    assert [tuple(r)[1:] for r in rows] == [(1, 1, 0), (-1, -1, -1), (-1, -1, -1), (0, 0, 1)]


def test_live_service_with_loaded_models(spark, tmp):
    """Trained pipelines, saved and loaded, vote in the live path; a model of
    another layout fails and makes the flow ACCEPT with predictions -1."""
    import json
    from flowlens.operators import models as MD
    from flowlens.sources import fixtures as fx
    pk = fx.packets(spark, SMOKE)
    x = feat.flow_features_78(feat.packet_flows(pk, 21600), keep=["close_id", "label"])
    train = x.withColumn("y", (F.col("label") != "BENIGN").cast("double")).drop("label")
    paths = {}
    for name, kind, kw in (("lr", "lr", {}), ("rf", "rf", {"trees": 5})):
        paths[name] = os.path.join(tmp, name)
        MD.save_model(MD.make_pipeline(train, feat.FEATURE_NAMES, kind, **kw).fit(train), paths[name])
    models = MD.load_models({**paths, "gone": os.path.join(tmp, "gone")})
    assert set(models) == {"lr", "rf"}
    cols = ["id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "tcp_flags"]
    folder = J.stage_packet_files(pk.select(cols), J.scratch(spark, "mod-in"), n_files=2)
    logs = {}
    for label, given in (("good", models), ("broken", {**models, "bad": _Broken()})):
        out = J.scratch(spark, f"mod-{label}")
        q = J.start_live(spark, folder, out, timeout_s=21600, trigger="1 second", idle_timeout_s=None, models=given)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        logs[label] = spark.read.parquet(out + "/flow_log").collect()
    want = {r.close_id: r for r in MD.model_votes(models)(feat.flow_features_78(
        feat.packet_flows(pk, 21600), keep=["close_id"])).collect()}
    assert len(logs["good"]) == len(want) == 450
    for r in logs["good"]:
        votes = json.loads(r.prediction)
        assert votes == {"lr": want[r.id].pred_lr, "rf": want[r.id].pred_rf}
        assert r.decision == ("DROP" if sum(votes.values()) > 1 else "ACCEPT") and r.timestamp_us > 0
    assert {r.decision for r in logs["broken"]} == {"ACCEPT"}
    assert all(set(json.loads(r.prediction).values()) == {-1} for r in logs["broken"])


class _Broken:
    """Stands for a model of another feature layout."""

    stages: list = []

    def transform(self, df):
        raise ValueError("model trained on another layout")


def test_state_of_closed_flows_goes(spark):
    from flowlens.streaming.flow_state import assemble_flows
    rows = [("a", "x", 1, 2, 6, i, i * 100, 50, 0) for i in range(12)]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
                                     "id long, ts_us long, length int, tcp_flags int")
    folder = J.stage_packet_files(df, J.scratch(spark, "drop-in"), n_files=4)
    assert sorted(os.listdir(folder))[0].startswith((".", "_", "part"))
    flows = assemble_flows(J.packet_stream(spark, folder, df.schema), 150 / 1e6, drop_closed=True)
    sink = J.scratch(spark, "drop-out")
    J.run_available(flows.select("first_id", "close_id", "n_pkts"), sink, sink + "-ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == [(i, i + 2, 3) for i in range(0, 12, 3)]


def test_stream_replay_equals_batch(spark):
    from flowlens.sources import fixtures as fx
    pk = fx.packets(spark, SMOKE)
    folder = J.stage_packet_files(pk, J.scratch(spark, "t-in"), n_files=3)
    s = J.packet_stream(spark, folder, pk.schema)
    out = J.flow_feature_stream(s, 21600, keep=["src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                                                "seg_no", "close_id"])
    sink = J.scratch(spark, "t-out")
    J.run_available(out, sink, sink + "-ckpt")
    streamed = spark.read.parquet(sink).select("close_id", "f2", "f4", "f16", "f19").toPandas()
    batch = feat.flow_features_78(feat.packet_flows(pk, 21600), keep=["close_id"]) \
        .select("close_id", "f2", "f4", "f16", "f19").toPandas()
    a = streamed.sort_values("close_id").reset_index(drop=True)
    b = batch.sort_values("close_id").reset_index(drop=True)
    assert len(a) == len(b) > 0
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "decision" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_observed_write_and_timestamp_parse(spark, tmp):
    df = spark.createDataFrame([("BENIGN", "1499340000.5"), ("DDoS", "7/7/2017 8:59:50"), ("BENIGN", "bad")],
                               "Label string, Timestamp string")
    stats = IO.write_observed(df, os.path.join(tmp, "obs"))
    assert stats["rows"] == 3 and stats["benign"] == 2
    ts = [r["ts_us"] for r in IO.parse_timestamp_column(df).collect()]
    assert ts[0] == 1499340000500000 and ts[1] is not None and ts[2] is None


def test_idle_flow_expires_with_event_time_timeout(spark):
    from flowlens.streaming.flow_state import assemble_flows
    schema = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, id long, ts_us long, " \
             "length int, tcp_flags int, label string"
    s = 1_000_000
    t0 = 1_700_000_000 * s  # event time must be after the initial watermark (epoch 0)
    part1 = [("a", "x", 1, 2, 6, 0, t0, 50, 0, "BENIGN"), ("a", "x", 1, 2, 6, 1, t0 + s, 60, 0, "BENIGN")]
    part2 = [("b", "x", 1, 2, 6, 2, t0 + 1000 * s, 70, 0, "BENIGN"),
             ("b", "x", 1, 2, 6, 3, t0 + 1001 * s, 80, 0, "BENIGN")]
    folder = J.scratch(spark, "idle-in")
    for part in (part1, part2):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = J.packet_stream(spark, folder, spark.read.parquet(folder).schema)
    flows = assemble_flows(stream, 10, idle_timeout_s=5, emit_idle=True, watermark="1 second")
    sink = J.scratch(spark, "idle-out")
    J.run_available(flows.select("src_ip", "n_pkts", "closed"), sink, sink + "-ckpt")
    got = {(r["src_ip"], r["n_pkts"], r["closed"]) for r in spark.read.parquet(sink).collect()}
    assert ("a", 2, False) in got            # idle flow emitted on timeout, marked open
    assert not any(ip == "b" for ip, _, _ in got)  # b is still open and not yet idle


def test_packet_records_skip_malformed(spark, tmp):
    p = os.path.join(tmp, "pk")
    os.makedirs(p)
    with open(os.path.join(p, "a.json"), "w") as f:
        f.write('{"id": 1, "ts_us": 10, "src_ip": "10.0.0.1", "length": 60}\n')
        f.write('{"id": 2, "ts_us": 11, "src_ip": null, "length": 40}\n')
        f.write('not json at all\n')
    good, bad = IO.read_packet_records(spark, p)
    assert sorted(r["id"] for r in good.collect()) == [1, 2]
    assert bad.count() == 1


def test_live_service_round_trip(spark):
    from flowlens.sources import fixtures as fx
    pk = fx.packets(spark, SMOKE).select("id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port",
                                         "protocol", "length", "tcp_flags")
    folder = J.stage_packet_files(pk, J.scratch(spark, "live-in"), n_files=2)
    out = J.scratch(spark, "live-out")
    q = J.start_live(spark, folder, out, timeout_s=21600, trigger="1 second", idle_timeout_s=None)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    log = spark.read.parquet(out + "/flow_log")
    assert log.count() == 450  # closed flows at sf0.001, T = 21600 s (FIXTURES.md)
    assert set(r["decision"] for r in log.select("decision").distinct().collect()) <= {"DROP", "ACCEPT"}


def test_stream_state_random_non_monotone_equals_batch(spark):
    import random
    from flowlens.streaming.flow_state import assemble_flows
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", "c"]), "x", 1, 2, rnd.choice([6, 17]), i, i * 20 + rnd.randint(0, 200),
             rnd.randint(40, 90), rnd.randint(0, 63), "BENIGN") for i in range(400)]
    schema = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, id long, ts_us long, " \
             "length int, tcp_flags int, label string"
    df = spark.createDataFrame(rows, schema)
    folder = J.stage_packet_files(df, J.scratch(spark, "rnd-in"), n_files=3)
    flows = assemble_flows(J.packet_stream(spark, folder, df.schema), 700 / 1e6)
    sink = J.scratch(spark, "rnd-out")
    cols = ["src_ip", "protocol", "seg_no", "n_pkts", "first_id", "close_id", "fwd_bytes", "iat_sum", "fwd_syn"]
    J.run_available(flows.select(*cols), sink, sink + "-ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select(*cols).collect())
    want = sorted(tuple(r) for r in feat.packet_flows(df, 700 / 1e6).select(*cols).collect())
    assert got == want and len(got) > 20


def test_package_is_shipped_to_workers(spark):
    from flowlens.session import ship_package
    ship_package(spark)
    ship_package(spark)  # once per application
    files = spark.sparkContext._jsc.sc().listFiles()
    assert any(str(f).endswith("flowlens.zip") for f in files.toList().mkString(",").split(","))
