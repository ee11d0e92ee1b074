"""Streaming queries: the packet table replayed as a file stream.

Each builder stages the packets (derived from ``events``) as files in id
order under the shared checkpoint folder, runs the streaming job until the
input is drained, and returns what the sink holds.  Stream results must
equal the batch results, so the batch oracles apply unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import votes as V
from flowlens.operators import models as MD
from flowlens.plans import flows as FL
from flowlens.plans import models as PM
from flowlens.plans import rules as _rules  # noqa: F401  (registers the flow_log oracle used below)
from flowlens.plans.registry import ORACLE, query
from flowlens.sources import fixtures as fx
from flowlens.streaming import jobs as J


def _staged_stream(spark: SparkSession, sf_dir: str, name: str):
    pk = fx.packets(spark, sf_dir)
    folder = J.stage_packet_files(pk, J.scratch(spark, f"{name}-in"))
    return J.packet_stream(spark, folder, pk.schema, files_per_batch=1)


@query("stream_flow_features", ORACLE["flow_features_78"])
def stream_flow_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1/ST2/ST5: stateful stream assembly (4 micro-batches) -> features;
    equals the batch flow_features_78."""
    s = _staged_stream(spark, sf_dir, "features")
    out = FL._round_std(J.flow_feature_stream(s, FL.TIMEOUT_S))
    sink = J.scratch(spark, "features-out")
    J.run_available(out, sink, sink + "-ckpt")
    return spark.read.parquet(sink)


@query("stream_flow_log", ORACLE["flow_log"])
def stream_flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4/K6/R1: foreachBatch scoring of closed flows -> flow log (+ rules)."""
    s = _staged_stream(spark, sf_dir, "log")
    feats = J.flow_feature_stream(s, FL.TIMEOUT_S, keep=[*FL.KEY5, "seg_no", "close_id", "end_us"])
    base = J.scratch(spark, "log-out")
    sink = J.decision_sink(base + "/flow_log", base + "/rules")
    q = (feats.writeStream.foreachBatch(sink).option("checkpointLocation", base + "/ckpt")
              .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(base + "/flow_log").drop("batch_id")


STREAM_RULES_SQL = fx.with_views(FL._flow_rows_sql(FL.TIMEOUT_S) + """,
v AS (SELECT *, CASE WHEN bytes > 400 THEN 1 ELSE 0 END AS pred_rf,
        CASE WHEN f_syn > 0 THEN 1 ELSE 0 END AS pred_lr,
        CASE WHEN (CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END) < 3600 THEN 1 ELSE 0 END AS pred_mlp
      FROM agg)
SELECT close_id AS rule_id, end_us AS added_at_us, src_ip, NULL::VARCHAR AS dst_ip, NULL::INTEGER AS src_port,
  NULL::INTEGER AS dst_port, NULL::INTEGER AS protocol, 'DROP' AS action,
  end_us + 600::BIGINT * 1000000 AS expiry_us, 'auto-detect' AS reason
FROM v WHERE pred_rf + pred_lr + pred_mlp > 1""", "packets")


@query("stream_block_rules", STREAM_RULES_SQL)
def stream_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4/R1: rules appended by the streaming scorer for DROP flows."""
    s = _staged_stream(spark, sf_dir, "rules")
    feats = J.flow_feature_stream(s, FL.TIMEOUT_S, keep=[*FL.KEY5, "seg_no", "close_id", "end_us"])
    base = J.scratch(spark, "rules-out")
    q = (feats.writeStream.foreachBatch(J.decision_sink(base + "/flow_log", base + "/rules"))
              .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(base + "/rules").drop("batch_id")



# Fixture choices: flows end after this silence; the watermark's delay.
IDLE_S = 7200
DELAY_S = 600

#: Flows that end at the anchored timeout or in silence, whichever is first,
#: by hops from start to start; the last flow of a key ends when the final
#: watermark has passed its timer.
IDLE_SQL = fx.with_views(f"""WITH RECURSIVE p AS (
  SELECT *, concat_ws('|', src_ip, dst_ip, src_port, dst_port, protocol) AS k,
    row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY id) AS rn,
    ts_us - lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY id) AS gap FROM packets),
c AS (SELECT a.k, a.rn, b.rn AS close_rn FROM p a ASOF JOIN p b ON a.k = b.k AND a.ts_us + {FL.TIMEOUT_S}::BIGINT * 1000000 < b.ts_us),
g AS (SELECT k, rn, min(CASE WHEN gap > {IDLE_S}::BIGINT * 1000000 THEN rn END) OVER (PARTITION BY k ORDER BY rn
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gap_rn, max(rn) OVER (PARTITION BY k) AS last_rn FROM p),
hop AS (SELECT g.k, g.rn, coalesce(gap_rn <= coalesce(close_rn, gap_rn), false) AS idle, close_rn, gap_rn, last_rn
  FROM g LEFT JOIN c ON c.k = g.k AND c.rn = g.rn),
seg AS (SELECT k, 1::BIGINT AS rn FROM p WHERE p.rn = 1
  UNION ALL
  SELECT h.k, CASE WHEN idle THEN gap_rn ELSE close_rn + 1 END FROM seg s JOIN hop h ON h.k = s.k AND h.rn = s.rn
  WHERE (idle OR close_rn IS NOT NULL) AND CASE WHEN idle THEN gap_rn ELSE close_rn + 1 END <= last_rn),
f AS (SELECT h.k, h.rn, CASE WHEN idle THEN gap_rn - 1 ELSE coalesce(close_rn, last_rn) END AS end_rn,
  NOT idle AND close_rn IS NOT NULL AS closed, NOT idle AND close_rn IS NULL AS at_end FROM seg s JOIN hop h ON h.k = s.k AND h.rn = s.rn),
w AS (SELECT max(ts_us) // 1000 - {DELAY_S} * 1000 AS mark FROM packets)
SELECT p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol, min(p.id) AS first_id, max(p.id) AS close_id,
  count(*)::BIGINT AS n_pkts, sum(p.length)::BIGINT AS fwd_bytes, arg_max(p.ts_us, p.id) AS end_us, bool_or(f.closed) AS closed
FROM f JOIN p ON p.k = f.k AND p.rn BETWEEN f.rn AND f.end_rn, w
GROUP BY p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol, f.rn, f.at_end, w.mark
HAVING NOT f.at_end OR arg_max(p.ts_us, p.id) // 1000 + {IDLE_S} * 1000 + 1 <= w.mark""", "packets")


@query("stream_idle_flows", IDLE_SQL)
def stream_idle_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: flows that close, and flows that end in silence (two hours of event
    time), told by the next packet or by a timer behind the watermark."""
    s = _staged_stream(spark, sf_dir, "idle")
    out = J.assemble_flows(s, FL.TIMEOUT_S, idle_timeout_s=IDLE_S, emit_idle=True, watermark=f"{DELAY_S} seconds",
                           drop_closed=True)
    sink = J.scratch(spark, "idle-out")
    J.run_available(out.select(*FL.KEY5, "first_id", "close_id", "n_pkts", "fwd_bytes", "end_us", "closed"),
                    sink, sink + "-ckpt")
    return spark.read.parquet(sink)


# Packet records as JSON text; every 17th one breaks off.
RECORDS = "id long, ts_us long, src_ip string, length int"
_LINE = """CASE WHEN id % 17 = 0 THEN concat('{"id": ', CAST(id AS STRING), ', "src_ip": "', src_ip)
  ELSE concat('{"id": ', CAST(id AS STRING), ', "ts_us": ', CAST(ts_us AS STRING), ', "src_ip": "', src_ip, '", "length": ',
              CAST(length AS STRING), '}') END"""


def _intake(spark: SparkSession, sf_dir: str, name: str) -> str:
    folder, out = J.scratch(spark, f"{name}-in"), J.scratch(spark, f"{name}-out")
    lines = fx.packets(spark, sf_dir).selectExpr("id", f"{_LINE} AS value")
    lines.repartitionByRange(4, "id").sortWithinPartitions("id").select("value").write.text(folder)
    q = J.packet_intake(spark, folder, out, T.StructType.fromDDL(RECORDS), files_per_batch=1).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


@query("stream_good_packets", fx.with_views("SELECT id, ts_us, src_ip, length FROM packets WHERE id % 17 <> 0", "packets"))
def stream_good_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed records of a record stream with broken ones."""
    return spark.read.parquet(_intake(spark, sf_dir, "good") + "/packets").select("id", "ts_us", "src_ip", "length")


@query("stream_bad_packets", fx.with_views(
    "SELECT '{\"id\": ' || id || ', \"src_ip\": \"' || src_ip AS raw FROM packets WHERE id % 17 = 0", "packets"))
def stream_bad_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The malformed records of that stream, with their raw text."""
    return spark.read.parquet(_intake(spark, sf_dir, "bad") + "/malformed").select("raw")


@query("stream_model_decisions", fx.with_views(FL._flow_rows_sql(FL.TIMEOUT_S) + """
SELECT close_id AS id, end_us AS timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol,
  true AS votes_ok, true AS decision_ok FROM agg""", "packets"))
def stream_model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 with trained models: two pipelines, trained on the batch flows,
    saved and loaded, vote on each flow that the stream closes.  Checked: the
    votes are those of the loaded models on the batch features, the decision
    is their strict majority."""
    data = PM.training_set(spark, sf_dir)
    train = data.where("split = 'train'").drop("split")
    paths = {}
    for kind, kw in (("lr", {}), ("rf", {"trees": 20})):
        paths[kind] = J.scratch(spark, f"model-{kind}")
        MD.save_model(MD.fit_cached(MD.make_pipeline(train, PM.FEATURES, kind, **kw), train), paths[kind])
    models = MD.load_models(paths)
    s = _staged_stream(spark, sf_dir, "models")
    feats = J.flow_feature_stream(s, FL.TIMEOUT_S, keep=[*FL.KEY5, "seg_no", "close_id", "end_us"])
    base = J.scratch(spark, "models-out")
    sink = J.decision_sink(base + "/flow_log", base + "/rules", MD.ModelVotes(models), tuple(models))
    q = (feats.writeStream.foreachBatch(sink).option("checkpointLocation", base + "/ckpt")
              .trigger(availableNow=True).start())
    q.awaitTermination()
    log = spark.read.parquet(base + "/flow_log").drop("batch_id")
    # features differ in the last bits between stream and batch: a vote may
    # only differ where the batch model is undecided
    want = data
    for name, model in models.items():
        want = MD.score(model, want, name)
    want = want.select(F.col("close_id").alias("id"), *[c for n in models for c in (f"pred_{n}", f"conf_{n}")])
    votes = F.from_json("prediction", "map<string,int>")
    rows = log.withColumn("v", votes).join(want, "id")
    same, ones = F.lit(True), F.lit(0)
    for n in models:
        same = same & ((F.col("v")[n] == F.col(f"pred_{n}")) | (F.col(f"conf_{n}") < 0.5 + 1e-6))
        ones = ones + F.col("v")[n]
    decided = F.when(ones > len(models) // 2, V.DROP).otherwise(V.ACCEPT)
    return rows.select("id", "timestamp_us", *FL.KEY5, F.coalesce(same, F.lit(False)).alias("votes_ok"),
                       (F.col("decision") == decided).alias("decision_ok"))
