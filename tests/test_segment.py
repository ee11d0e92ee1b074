"""Anchored-timeout segmentation against a plain per-key Python loop."""

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from flowlens.operators.features import flow_aggregates
from flowlens.operators.segment import closed_flow_rows, segment_flows

KEY = ["k"]
SCHEMA = "id long, k string, ts_us long, length int, label string"


def plain_loop(rows, t):
    """Per key, in id order: open, append, close when ts - start > t."""
    out, state = {}, {}
    for rid, k, ts, _, _ in sorted(rows, key=lambda r: r[0]):
        st = state.setdefault(k, {"seg": 0, "start": None, "rows": []})
        if st["start"] is None:
            st["start"], st["rows"] = ts, []
        st["rows"].append(rid)
        if ts - st["start"] > t:
            for r in st["rows"]:
                out[r] = st["seg"]
            st["seg"] += 1
            st["start"] = None
    return out


def run(spark, rows, t, batch=None):
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        seg = closed_flow_rows(segment_flows(df, t / 1e6, key=KEY), key=KEY)
        return {r["id"]: r["seg_no"] for r in seg.select("id", "seg_no").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed,monotone", [(1, True), (2, True), (3, False), (4, False)])
def test_random_against_loop(spark, seed, monotone):
    rnd = random.Random(seed)
    rows, ts = [], 0
    for i in range(600):
        ts = ts + rnd.randint(0, 9) if monotone else rnd.randint(0, 3000)
        rows.append((i, rnd.choice(["a", "b", "c", None]), ts, rnd.randint(40, 90), "x"))
    t = 25
    assert run(spark, rows, t, batch=7) == plain_loop(rows, t)


def test_equal_to_timeout_does_not_close(spark):
    rows = [(0, "a", 0, 1, "x"), (1, "a", 10, 1, "x"), (2, "a", 11, 1, "y")]
    got = run(spark, rows, 10)
    assert got == {0: 0, 1: 0, 2: 0}  # 10 - 0 == T stays open, 11 closes


def test_single_packet_key_emits_nothing(spark):
    rows = [(0, "a", 0, 1, "x"), (1, "b", 100, 1, "x"), (2, "b", 200, 1, "x")]
    assert run(spark, rows, 50) == {1: 0, 2: 0}


def test_closing_row_label_and_stats(spark):
    rows = [(0, "a", 0, 10, "BENIGN"), (1, "a", 5, 20, "BENIGN"), (2, "a", 30, 30, "DDoS")]
    df = spark.createDataFrame(rows, SCHEMA)
    seg = segment_flows(df, 20 / 1e6, key=KEY)
    f = flow_aggregates(seg.withColumn("tcp_flags", F.lit(0)).withColumn("protocol", F.lit(17)),
                        key=KEY).collect()[0]
    assert f["label"] == "DDoS" and f["closed"]
    assert f["iat_n"] == 2 and f["iat_sum"] == 30 and f["iat_min"] == 5 and f["iat_max"] == 25
    assert f["fwd_bytes"] == 60 and f["bwd_pkts"] == 0


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(gaps=st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=120),
       keys=st.lists(st.sampled_from(["a", "b", None]), min_size=120, max_size=120),
       t=st.integers(min_value=0, max_value=60), batch=st.integers(min_value=1, max_value=9))
def test_property_sweep_equals_loop(spark, gaps, keys, t, batch):
    ts, rows = 0, []
    for i, g in enumerate(gaps):
        ts += g
        rows.append((i, keys[i], ts, 1, "x"))
    assert run(spark, rows, t, batch=batch) == plain_loop(rows, t)


def test_bidirectional_per_direction_gaps(spark):
    from flowlens.operators.cicids import flow_features_cicids
    from flowlens.operators.features import packet_flows
    schema = ("id long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
              "length int, tcp_flags int")
    # one conversation, both directions interleaved; the 6th packet closes it (T = 100 us)
    rows = [(0, 0, "1.1.1.1", "2.2.2.2", 5000, 80, 6, 60, 2),
            (1, 10, "2.2.2.2", "1.1.1.1", 80, 5000, 6, 70, 18),
            (2, 30, "1.1.1.1", "2.2.2.2", 5000, 80, 6, 80, 16),
            (3, 35, "2.2.2.2", "1.1.1.1", 80, 5000, 6, 90, 16),
            (4, 70, "2.2.2.2", "1.1.1.1", 80, 5000, 6, 100, 16),
            (5, 150, "1.1.1.1", "2.2.2.2", 5000, 80, 6, 110, 1)]
    df = spark.createDataFrame(rows, schema)
    flows = packet_flows(df, 100 / 1e6, direction="bidirectional")
    f = flows.first()
    assert (f["fwd_pkts"], f["bwd_pkts"], f["fwd_bytes"], f["bwd_bytes"]) == (3, 3, 250, 260)
    assert (f["fwd_iat_n"], f["fwd_iat_sum"], f["fwd_iat_min"], f["fwd_iat_max"]) == (2, 150, 30, 120)
    assert (f["bwd_iat_n"], f["bwd_iat_sum"], f["bwd_iat_min"], f["bwd_iat_max"]) == (2, 60, 25, 35)
    assert f["iat_sum"] == 150 and f["iat_min"] == 5 and f["iat_max"] == 80
    c = flow_features_cicids(flows).first()
    assert c["f20"] == 150 / 1e6 and c["f25"] == 60 / 1e6 and c["f51"] == 1.0


@pytest.mark.parametrize("seed,t,chunk", [(21, 25, 40), (22, 5, 40), (23, 400, 40), (24, 5000, 15), (25, 60, 7)])
def test_hot_key_split_equals_loop(spark, seed, t, chunk):
    """Hot keys cut into chunks (tiny thresholds, T from a part of a chunk to
    more than a key's span) give the sequential result; key c has times that
    do not rise, ids are far from evenly spaced."""
    from flowlens.operators.hotkeys import segment_flows_split
    rnd = random.Random(seed)
    rows, ts = [], {"a": 0, "b": 0, "c": 0}
    for i in range(900):
        k = rnd.choice(["a", "a", "a", "b", "c", None])
        kk = k or "c"
        ts[kk] += rnd.randint(0, 9)
        t_row = ts[kk] if k != "c" else rnd.randint(0, 3000)   # key c: not monotone
        rows.append((i if i < 890 else i * 10**9, k, t_row, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    out = segment_flows_split(df, t / 1e6, key=KEY, hot_key_rows=50, chunk_rows=chunk, anchor_cols=("ts_us",))
    got = {r["id"]: r["seg_no"] for r in closed_flow_rows(out, key=KEY).select("id", "seg_no").collect()}
    assert got == plain_loop(rows, t)
    cols = ["id", "seg_no", "start_us", "iat_us", "closes", "anchor_ts_us"]
    full = sorted(tuple(r) for r in out.select(cols).collect())
    ref = sorted(tuple(r) for r in segment_flows(df, t / 1e6, key=KEY, anchor_cols=("ts_us",)).select(cols).collect())
    assert full == ref


def test_chunks_follow_row_counts_not_id_widths(spark):
    """One far id does not put a key's rows into one chunk."""
    from flowlens.operators import hotkeys
    plain = hotkeys._chunk_transitions
    rows = [(i if i < 3999 else 10**15, "a", i, 1, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    acc = spark.sparkContext.accumulator(0)

    def watched(t):
        fn = plain(t)

        def run(pdf):
            acc.add(len(pdf) > 1000)
            return fn(pdf)
        return run
    hotkeys._chunk_transitions = watched
    try:
        out = hotkeys.segment_flows_split(df, 10 / 1e6, key=KEY, hot_key_rows=50, chunk_rows=500)
        assert out.count() == 4000 and acc.value == 0
    finally:
        hotkeys._chunk_transitions = plain


def test_dense_key_with_a_timeout_over_many_chunks(spark):
    """A timeout of 60 chunks: the tree holds transitions of limits that can
    occur, one row each, and the result is that of one sweep."""
    from flowlens.operators import hotkeys
    rnd = random.Random(9)
    rows, ts = [], 0
    for i in range(3000):
        ts += rnd.randint(1, 3)
        rows.append((i, "a", ts, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, composed = [], hotkeys._composed

    def watched(table, groups, t):
        out = composed(table, groups, t)
        sizes.append(out.count())
        return out
    hotkeys._composed = watched
    try:
        out = hotkeys.segment_flows_split(df, 1200 / 1e6, key=KEY, hot_key_rows=50, chunk_rows=50)
        cols = ["id", "seg_no", "start_us", "iat_us", "closes"]
        assert sorted(map(tuple, out.select(cols).collect())) == sorted(
            map(tuple, segment_flows(df, 1200 / 1e6, key=KEY).select(cols).collect()))
    finally:
        hotkeys._composed = composed
    assert len(sizes) >= 5 and max(sizes) <= 3000 + 64


def test_only_the_last_flow_of_a_key_is_left_out(spark):
    rows = [(i, k, i * 10, 1, "x") for i, k in enumerate(["a", "a", "a", None, "b", None, None, "a", "b", "a"])]
    got = run(spark, rows, 15)
    assert got == plain_loop(rows, 15)


def test_closing_rows_equal_loop():
    from flowlens.operators.segment import closing_rows
    rnd = np.random.default_rng(2)
    for m in (0, 1, 2, 7, 64, 65, 300):
        for ts in (rnd.integers(0, 200, m), np.sort(rnd.integers(0, 200, m))):
            for t in (0, 10, 500):
                want = [next((i for i in range(j, m) if ts[i] > ts[j] + t), m) for j in range(m)]
                assert closing_rows(ts.astype(np.int64), t).tolist() == want


def test_tasks_do_not_follow_the_number_of_chunks(spark, monkeypatch):
    """60 chunks lie in as many range partitions as any shuffle has."""
    from flowlens.operators import hotkeys
    rnd = random.Random(10)
    rows, ts = [], 0
    for i in range(1200):
        ts += rnd.randint(0, 3)
        rows.append((i * 7, rnd.choice(["a", None]), ts, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    parts, chunks, plain = [], [], hotkeys.reliable_checkpoint

    def watched(frame):
        out = plain(frame)
        parts.append(out.select(F.spark_partition_id()).distinct().count())
        if "_chunk" in out.columns:
            chunks.append(out.select("_k", "_chunk").distinct().count())
        return out
    monkeypatch.setattr(hotkeys, "reliable_checkpoint", watched)
    out = hotkeys.segment_flows_split(df, 40 / 1e6, key=KEY, hot_key_rows=50, chunk_rows=20)
    cols = ["id", "seg_no", "start_us", "iat_us", "closes"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(
        map(tuple, segment_flows(df, 40 / 1e6, key=KEY).select(cols).collect()))
    assert min(chunks) >= 60 and max(parts) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_size_estimates_do_not_multiply_over_the_tree(spark, monkeypatch):
    """A checkpoint keeps the size estimated for its plan, and a join's is the
    product of its sides': over the tree's levels it must stay a long."""
    from flowlens.operators import hotkeys, scan
    rows, ts, rnd = [], 0, random.Random(11)
    for i in range(160):
        ts += rnd.randint(0, 3)
        rows.append((i, "a", ts, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, plain = [], hotkeys.reliable_checkpoint

    def watched(frame):
        out = plain(frame)
        sizes.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes())
        return out
    for module in (hotkeys, scan):
        monkeypatch.setattr(module, "reliable_checkpoint", watched)
    out = hotkeys.segment_flows_split(df, 40 / 1e6, key=KEY, hot_key_rows=50, chunk_rows=20)
    cols = ["id", "seg_no", "start_us", "iat_us", "closes"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(
        map(tuple, segment_flows(df, 40 / 1e6, key=KEY).select(cols).collect()))
    assert max(sizes) < 2 ** 63


def test_checkpoints_without_the_estimate_keep_rows_and_columns(spark):
    from flowlens.session import reliable_checkpoint
    rows = [(1, None), (2, "x"), (2, "x"), (None, "y")]
    df = first = spark.createDataFrame(rows, "a int, b string")
    other = spark.range(50).select(F.col("id").cast("int").alias("c"))
    for _ in range(8):  # each round squares the estimate
        df = reliable_checkpoint(df.join(df.select(F.col("a").alias("c")).join(other, "c", "left_anti"), F.col("a") < F.col("c"), "left")
                                 .select("a", "b"))
        assert df._jdf.queryExecution().analyzed().stats().sizeInBytes() < 2 ** 63
    assert df.schema == first.schema
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
