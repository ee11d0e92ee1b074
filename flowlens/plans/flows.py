"""Flow queries: segmentation, per-flow aggregates, feature layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import features as feat
from flowlens.operators.cicids import flow_features_cicids
from flowlens.operators.hotkeys import segment_flows_split
from flowlens.operators.segment import KEY5, closed_flow_rows
from flowlens.functions.numeric import round_half_away as rnd
from flowlens.plans.registry import query
from flowlens.sources import fixtures as fx
from flowlens.streaming.jobs import stand_in_votes

# Fixed values from FIXTURES.md: the working timeout and the degenerate one.
TIMEOUT_S = 21600
TIMEOUT_SHORT_S = 10
# Rows of the first-N query; the operator takes any n.
FIRST_N = 1000
STD_SLOTS = (9, 13, 17, 57, 61, 71)


def _flows(spark, sf_dir, timeout_s=TIMEOUT_S, **kw):
    return feat.packet_flows(fx.packets(spark, sf_dir), timeout_s, **kw)


# --------------------------------------------------------------------------
# DuckDB oracle: row numbers per key, an ASOF join to the first row past the
# anchor + T, a recursive hop from anchor to anchor (valid because ts rises
# strictly with id), then plain aggregates.

def _flow_rows_sql(t: int, emit_open: bool = False) -> str:
    open_rows = """
  UNION ALL
  SELECT s.k, s.seg_no, s.start_rn, m.max_rn, false
  FROM seg s JOIN (SELECT k, max(rn) AS max_rn FROM p GROUP BY k) m ON m.k=s.k
  WHERE s.start_rn <= m.max_rn AND NOT EXISTS (SELECT 1 FROM nxt n WHERE n.k=s.k AND n.rn=s.start_rn)""" if emit_open else ""
    return f"""WITH RECURSIVE p AS (
  SELECT *, concat_ws('|',src_ip,dst_ip,src_port,dst_port,protocol) AS k,
         row_number() OVER (PARTITION BY src_ip,dst_ip,src_port,dst_port,protocol ORDER BY id) AS rn
  FROM packets),
nxt AS (
  SELECT a.k, a.rn, b.rn AS close_rn
  FROM p a ASOF JOIN p b ON a.k=b.k AND a.ts_us + {t}::BIGINT*1000000 < b.ts_us),
seg AS (
  SELECT k, 1::BIGINT AS start_rn, 0::BIGINT AS seg_no FROM p WHERE rn=1
  UNION ALL
  SELECT s.k, n.close_rn+1, s.seg_no+1
  FROM seg s JOIN nxt n ON n.k=s.k AND n.rn=s.start_rn),
flows AS (
  SELECT s.k, s.seg_no, s.start_rn, n.close_rn, true AS closed
  FROM seg s JOIN nxt n ON n.k=s.k AND n.rn=s.start_rn{open_rows}),
fp AS (
  SELECT p.*, f.seg_no, f.close_rn, f.closed,
         p.ts_us - lag(p.ts_us) OVER (PARTITION BY p.k, f.seg_no ORDER BY p.id) AS iat_us
  FROM flows f JOIN p ON p.k=f.k AND p.rn BETWEEN f.start_rn AND f.close_rn),
agg AS (
  SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no,
    count(*)::BIGINT AS n_pkts, sum(length)::BIGINT AS bytes,
    min(length) AS len_min, max(length) AS len_max, stddev_pop(length) AS len_std, var_pop(length) AS len_var,
    arg_min(ts_us, id) AS start_us, arg_max(ts_us, id) AS end_us,
    count(iat_us)::BIGINT AS iat_n, sum(iat_us)::BIGINT AS iat_sum, min(iat_us) AS iat_min,
    max(iat_us) AS iat_max, stddev_pop(iat_us) AS iat_std,
    {", ".join(f"sum(CASE WHEN protocol=6 AND (tcp_flags & {m})<>0 THEN 1 ELSE 0 END)::BIGINT AS f_{n.lower()}"
               for n, m in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32)))},
    arg_max(label, id) AS label, min(id) AS first_id, max(id) AS close_id, bool_or(closed) AS closed
  FROM fp GROUP BY src_ip, dst_ip, src_port, dst_port, protocol, seg_no)"""


def _features_sql(t: int, keys: str = "src_ip, dst_ip, src_port, dst_port, protocol, seg_no, close_id, label",
                  emit_open: bool = False) -> str:
    e = "0.000001"
    slots = ["0.0"] * 78
    slots[0] = "dst_port"
    slots[1] = "(end_us - start_us) / 1000000.0"
    slots[2], slots[3], slots[4], slots[5] = "n_pkts", "0", "bytes", "0"
    slots[6], slots[7], slots[8], slots[9] = "len_max", "len_min", "bytes::DOUBLE / n_pkts", "round(len_std, 6)"
    slots[10] = slots[11] = slots[12] = e
    slots[13] = f"round({e}, 6)"
    slots[14], slots[15] = "bytes", "n_pkts"
    im = "CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END"
    isd = "CASE WHEN iat_n > 0 THEN round(iat_std / 1000000.0, 6) ELSE 0 END"
    imax = "CASE WHEN iat_n > 0 THEN iat_max / 1000000.0 ELSE 0 END"
    imin = "CASE WHEN iat_n > 0 THEN iat_min / 1000000.0 ELSE 0 END"
    slots[16], slots[17], slots[18], slots[19] = im, isd, imax, imin
    for i, n in enumerate(("fin", "syn", "rst", "psh", "ack", "urg")):
        slots[42 + i] = f"f_{n}"
        slots[48 + i] = "0"
    slots[54], slots[55], slots[56], slots[57] = "len_min", "len_max", "bytes::DOUBLE / n_pkts", "round(len_std, 6)"
    slots[58] = slots[59] = slots[60] = e
    slots[61] = f"round({e}, 6)"
    slots[62], slots[63], slots[64] = "bytes", "0", "bytes"
    slots[65], slots[66], slots[67] = "n_pkts", "0", "n_pkts"
    slots[68], slots[69], slots[70], slots[71] = imin, imax, im, isd
    cols = ", ".join(f"CAST({s} AS DOUBLE) AS f{i}" for i, s in enumerate(slots))
    return fx.with_views(_flow_rows_sql(t, emit_open) + f"""
SELECT {keys}, {cols} FROM agg""", "packets")


def _round_std(df: DataFrame) -> DataFrame:
    return df.withColumns({f"f{i}": rnd(f"f{i}", 6) for i in STD_SLOTS})


def _listed(segmented: DataFrame) -> DataFrame:
    return closed_flow_rows(segmented.select(*KEY5, "id", "seg_no", "closes"))


# --------------------------------------------------------------------------

@query("flow_segments", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT id, seg_no FROM fp""", "packets"))
def flow_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet of a closed flow with its flow number (T = 21600 s)."""
    pk = fx.packets(spark, sf_dir).select(*KEY5, "id", "ts_us")  # prune before the sweep
    return _listed(segment_flows_split(pk, TIMEOUT_S)).select("id", "seg_no")


@query("flow_segments_t10", fx.with_views(_flow_rows_sql(TIMEOUT_SHORT_S) + """
SELECT id, seg_no FROM fp""", "packets"))
def flow_segments_t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 with the short offline timeout (mostly two-packet flows)."""
    pk = fx.packets(spark, sf_dir).select(*KEY5, "id", "ts_us")
    return _listed(segment_flows_split(pk, TIMEOUT_SHORT_S)).select("id", "seg_no")


@query("flow_segments_split", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT id, seg_no FROM fp""", "packets"))
def flow_segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 by the hot-key path: every key of 50 packets or more is cut into
    chunks of about 100 rows (T covers many chunks); same oracle."""
    pk = fx.packets(spark, sf_dir).select(*KEY5, "id", "ts_us")
    seg = segment_flows_split(pk, TIMEOUT_S, hot_key_rows=50, chunk_rows=100)
    return _listed(seg).select("id", "seg_no")


@query("flow_totals", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no,
       n_pkts AS fwd_pkts, 0::BIGINT AS bwd_pkts, bytes AS fwd_bytes, 0::BIGINT AS bwd_bytes,
       (end_us - start_us) / 1000000.0 AS duration_s, start_us, end_us
FROM agg""", "packets"))
def flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: per closed flow packet/byte totals per direction and duration."""
    f = _flows(spark, sf_dir)
    return f.select(*KEY5, "seg_no", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes",
                    ((F.col("end_us") - F.col("start_us")) / feat.US).alias("duration_s"),
                    "start_us", "end_us")


@query("flow_length_stats", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no,
  bytes::DOUBLE / n_pkts AS fwd_len_mean, round(len_std, 6) AS fwd_len_std,
  len_min::DOUBLE AS fwd_len_min, len_max::DOUBLE AS fwd_len_max,
  0.000001::DOUBLE AS bwd_len_mean, 0.000001::DOUBLE AS bwd_len_std,
  0.000001::DOUBLE AS bwd_len_min, 0.000001::DOUBLE AS bwd_len_max
FROM agg""", "packets"))
def flow_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: safe length stats; an empty direction gives 1e-6 four times."""
    f = _flows(spark, sf_dir)
    ls = feat.length_stats(f)
    return f.select(*KEY5, "seg_no", *[ls[c].alias(c) for c in ls]).withColumns(
        {"fwd_len_std": rnd("fwd_len_std", 6), "bwd_len_std": rnd("bwd_len_std", 6)})


@query("flow_iat_stats", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no,
  CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END AS iat_mean,
  CASE WHEN iat_n > 0 THEN round(iat_std / 1000000.0, 6) ELSE 0 END AS iat_std,
  CASE WHEN iat_n > 0 THEN iat_max / 1000000.0 ELSE 0 END AS iat_max,
  CASE WHEN iat_n > 0 THEN iat_min / 1000000.0 ELSE 0 END AS iat_min
FROM agg""", "packets"))
def flow_iat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inter-arrival stats from the gap the sweep carries."""
    f = _flows(spark, sf_dir)
    it = feat.iat_stats(f)
    return f.select(*KEY5, "seg_no", *[it[c].cast("double").alias(c) for c in it]).withColumn(
        "iat_std", rnd("iat_std", 6))


@query("flow_flag_counts", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no,
  f_fin AS fwd_fin, f_syn AS fwd_syn, f_rst AS fwd_rst, f_psh AS fwd_psh, f_ack AS fwd_ack, f_urg AS fwd_urg,
  0::BIGINT AS bwd_fin, 0::BIGINT AS bwd_syn, 0::BIGINT AS bwd_rst, 0::BIGINT AS bwd_psh,
  0::BIGINT AS bwd_ack, 0::BIGINT AS bwd_urg
FROM agg""", "packets"))
def flow_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-direction counts of FIN, SYN, RST, PSH, ACK, URG."""
    f = _flows(spark, sf_dir)
    cols = [f"{d}_{n}" for d in ("fwd", "bwd") for n in ("fin", "syn", "rst", "psh", "ack", "urg")]
    return f.select(*KEY5, "seg_no", *[F.col(c).cast("long").alias(c) for c in cols])


@query("flow_features_78", _features_sql(TIMEOUT_S))
def flow_features_78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the 78-slot vector per closed flow, plus key, flow number, label."""
    f = _flows(spark, sf_dir)
    return _round_std(feat.flow_features_78(f, keep=[*KEY5, "seg_no", "close_id", "label"]))


@query("flow_features_78_t10", _features_sql(TIMEOUT_SHORT_S))
def flow_features_78_t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir, TIMEOUT_SHORT_S)
    return _round_std(feat.flow_features_78(f, keep=[*KEY5, "seg_no", "close_id", "label"]))


@query("flow_direction", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT id, seg_no, 1 AS is_fwd FROM fp""", "packets"))
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet direction inside its flow (directed key: always forward)."""
    pk = fx.packets(spark, sf_dir).select(*KEY5, "id", "ts_us")
    seg = _listed(segment_flows_split(pk, TIMEOUT_S))
    return seg.select("id", "seg_no", feat.direction_column("directed").cast("int").alias("is_fwd"))


@query("class_balance", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT count_if(upper(trim(label)) LIKE '%BENIGN%')::BIGINT AS benign,
       count_if(NOT (upper(trim(label)) LIKE '%BENIGN%'))::BIGINT AS attack
FROM agg""", "packets"))
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benign vs attack flows (substring rule on the flow label)."""
    from flowlens.operators.clean import class_balance as cb
    return cb(_flows(spark, sf_dir), "label")


@query("first_n_flows", fx.with_views(_flow_rows_sql(TIMEOUT_S) + f"""
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no, close_id
FROM agg QUALIFY row_number() OVER (ORDER BY close_id) <= {FIRST_N}""", "packets"))
def first_n_flows(spark: SparkSession, sf_dir: str, n: int = FIRST_N) -> DataFrame:
    """The first ``n`` flows in emission (closing-row) order, as an
    exact cut on close-id buckets (no single-task top-n merge)."""
    from flowlens.operators.sampling import first_n
    from flowlens.session import reliable_checkpoint
    # the cut reads its input twice (bucket counts, then rows): materialise
    # the flows once instead of running the sweep twice
    f = reliable_checkpoint(_flows(spark, sf_dir).select(*KEY5, "seg_no", "close_id"))
    return first_n(f, "close_id", n)


@query("random_flow", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """
SELECT close_id, n_pkts AS fwd_pkts, bytes AS fwd_bytes FROM agg
QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', close_id, 42)), close_id) = 1""", "packets"))
def random_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded random flow row, label dropped (top-1, no full sort)."""
    from flowlens.operators.sampling import random_row
    f = _flows(spark, sf_dir).select("close_id", "fwd_pkts", "fwd_bytes")
    return random_row(f, "close_id", seed=42)


def _cicids_sql(t: int) -> str:
    e = "0.000001"
    dur = "((end_us - start_us) / 1000000.0)"
    ps = lambda x: f"CASE WHEN {dur} > 0 THEN {x} / {dur} ELSE 0 END"
    im = "CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END"
    isd = "CASE WHEN iat_n > 0 THEN round(iat_std / 1000000.0, 6) ELSE 0 END"
    imax = "CASE WHEN iat_n > 0 THEN iat_max / 1000000.0 ELSE 0 END"
    imin = "CASE WHEN iat_n > 0 THEN iat_min / 1000000.0 ELSE 0 END"
    isum = "CASE WHEN iat_n > 0 THEN iat_sum / 1000000.0 ELSE 0 END"
    s = ["NULL"] * 78
    s[0], s[1], s[2], s[3], s[4], s[5] = "dst_port", dur, "n_pkts", "0", "bytes", "0"
    s[6], s[7], s[8], s[9] = "len_max", "len_min", "bytes::DOUBLE / n_pkts", "round(len_std, 6)"
    s[10] = s[11] = s[12] = e
    s[13] = f"round({e}, 6)"
    s[14], s[15] = ps("bytes::DOUBLE"), ps("n_pkts::DOUBLE")
    s[16], s[17], s[18], s[19] = im, isd, imax, imin
    s[20], s[21], s[22], s[23], s[24] = isum, im, isd, imax, imin
    s[25] = s[26] = s[27] = s[28] = s[29] = "0"
    s[30], s[31], s[32], s[33] = "f_psh", "0", "f_urg", "0"
    s[36], s[37] = ps("n_pkts::DOUBLE"), ps("0.0")
    s[38], s[39], s[40], s[41], s[42] = "len_min", "len_max", "bytes::DOUBLE / n_pkts", "round(len_std, 6)", "round(len_var, 6)"
    for i, n in enumerate(("fin", "syn", "rst", "psh", "ack", "urg")):
        s[43 + i] = f"f_{n}"
    s[51], s[52], s[53], s[54] = "0", "bytes::DOUBLE / n_pkts", "bytes::DOUBLE / n_pkts", e
    for i in range(56, 62):
        s[i] = "0"
    s[62], s[63], s[64], s[65], s[69] = "n_pkts", "bytes", "0", "0", "20"
    cols = ", ".join(f"CAST({x} AS DOUBLE) AS f{i}" for i, x in enumerate(s))
    return fx.with_views(_flow_rows_sql(t) + f"""
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no, {cols} FROM agg""", "packets")


CICIDS_ROUND = (9, 13, 17, 22, 41, 42)


@query("flow_features_cicids", _cicids_sql(TIMEOUT_S))
def flow_features_cicids_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CICIDS-layout aggregates per closed flow (oracle below)."""
    f = _flows(spark, sf_dir)
    out = flow_features_cicids(f, keep=[*KEY5, "seg_no"])
    return out.withColumns({f"f{i}": rnd(f"f{i}", 6) for i in CICIDS_ROUND})


@query("flow_features_bidirectional", _features_sql(
    TIMEOUT_S, keys="src_ip AS ep_lo_ip, src_port AS ep_lo_port, dst_ip AS ep_hi_ip, dst_port AS ep_hi_port,"
                    " protocol, seg_no, close_id"))
def flow_features_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 option: canonical endpoints, forward = first packet's source."""
    f = _flows(spark, sf_dir, direction="bidirectional")
    return _round_std(feat.flow_features_78(f, keep=[*feat.BIDIR_KEY, "seg_no", "close_id"]))


@query("flow_features_emit_open", _features_sql(
    TIMEOUT_S, keys="src_ip, dst_ip, src_port, dst_port, protocol, seg_no, close_id, closed", emit_open=True))
def flow_features_emit_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 option: flows still open at the end are emitted too."""
    f = _flows(spark, sf_dir, emit_open=True)
    return _round_std(feat.flow_features_78(f, keep=[*KEY5, "seg_no", "close_id", "closed"]))


# --------------------------------------------------------------------------
# Flagship: flows -> features -> three threshold stand-ins for the models ->
# strict-majority decision.  The thresholds are fixture choices, not learned.

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.functions import votes as V
    f = _flows(spark, sf_dir)
    feats = stand_in_votes(feat.flow_features_78(f, keep=[*KEY5, "seg_no", "close_id", "end_us"]))
    names = ("rf", "lr", "mlp")
    cols = [f"pred_{n}" for n in names]
    return feats.select(
        *KEY5, "seg_no", "close_id", "end_us", F.col("f15").cast("long").alias("pkt_count"),
        F.to_json(V.predictions_map(names, cols)).alias("prediction"),
        V.majority_decision(cols).alias("decision"))


@query("flow_decisions", fx.with_views(_flow_rows_sql(TIMEOUT_S) + """,
v AS (SELECT *, CASE WHEN bytes > 400 THEN 1 ELSE 0 END AS pred_rf,
        CASE WHEN f_syn > 0 THEN 1 ELSE 0 END AS pred_lr,
        CASE WHEN (CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END) < 3600 THEN 1 ELSE 0 END AS pred_mlp
      FROM agg)
SELECT src_ip, dst_ip, src_port, dst_port, protocol, seg_no, close_id, end_us, n_pkts AS pkt_count,
  '{"rf":' || pred_rf || ',"lr":' || pred_lr || ',"mlp":' || pred_mlp || '}' AS prediction,
  CASE WHEN pred_rf + pred_lr + pred_mlp > 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision
FROM v""", "packets"))
def flow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 in batch form: per closed flow the votes and the ACCEPT/DROP decision."""
    return flagship(spark, sf_dir)
