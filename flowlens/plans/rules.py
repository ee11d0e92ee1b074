"""Rule-table queries (R1-R7), enforcement (J4) and the flow log (K6, T4).

Decisions come from the stand-in votes (DROP iff at least two of three say
1), placed on the packets they belong to (same id): the rule's source
address and event time are the packet's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import votes as V
from flowlens.operators import rules as R
from flowlens.operators import sampling as SM
from flowlens.plans import flows as FL
from flowlens.plans.registry import query
from flowlens.session import reliable_checkpoint
from flowlens.sources import fixtures as fx

PERMANENT_TTL = "CASE WHEN conf_rf >= 0.95 THEN 0 ELSE 600 END"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.votes(spark, sf_dir)
    d = v.select("row_id", "conf_rf", V.majority_decision(["pred_rf", "pred_lr", "pred_mlp"]).alias("decision"),
                 F.expr(PERMANENT_TTL).alias("ttl_s"))
    p = fx.packets(spark, sf_dir).select(F.col("id").alias("row_id"), "src_ip", "ts_us")
    return d.join(p, "row_id")


def rules_live(spark, sf_dir):
    return R.block_rules(decisions(spark, sf_dir), R.LIVE_TTL_S, id_col="row_id", ts_col="ts_us")


def rules_mixed(spark, sf_dir):
    """The rule table (600 s or permanent), materialised once in the shared
    checkpoint folder: in service it is a stored table, and the derived
    rule queries read it several times."""
    r = R.block_rules(decisions(spark, sf_dir), "ttl_s", id_col="row_id", ts_col="ts_us")
    return reliable_checkpoint(r)


def unblocks(spark, sf_dir):
    """Operator unblocks: every TLS (port 443) packet of a benign source."""
    p = fx.packets(spark, sf_dir)
    return p.where((F.col("dst_port") == 443) & (F.col("label") == "BENIGN")).select(
        "src_ip", F.col("ts_us").alias("unblock_us"))


def _rules_sql(ttl: str) -> str:
    return f"""dec AS (SELECT row_id, {ttl} AS ttl FROM votes WHERE pred_rf + pred_lr + pred_mlp > 1),
rules AS (SELECT d.row_id AS rule_id, p.ts_us AS added_at_us, p.src_ip, NULL::VARCHAR AS dst_ip,
  NULL::INTEGER AS src_port, NULL::INTEGER AS dst_port, NULL::INTEGER AS protocol, 'DROP' AS action,
  CASE WHEN ttl > 0 THEN p.ts_us + ttl::BIGINT * 1000000 END AS expiry_us, 'auto-detect' AS reason
  FROM dec d JOIN packets p ON p.id = d.row_id)"""


def rsql(body: str, ttl: str = "600") -> str:
    return fx.with_views(f"WITH {_rules_sql(ttl)}\n{body}", "packets", "votes")


COLS = ", ".join(R.RULE_COLUMNS)


@query("block_rules", rsql(f"SELECT {COLS} FROM rules"))
def block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule row per DROP decision, 600 s TTL, reason auto-detect."""
    return rules_live(spark, sf_dir)


@query("block_rules_permanent", rsql(f"SELECT {COLS} FROM rules", PERMANENT_TTL))
def block_rules_permanent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: TTL 0 -> permanent rule with NULL expiry."""
    return rules_mixed(spark, sf_dir)


@query("block_rules_record_only", rsql(
    "SELECT " + COLS.replace("reason", "reason || ' (no-root)' AS reason") + " FROM rules"))
def block_rules_record_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-only mode, one row per rule, reason marked '(no-root)'."""
    return R.record_only(rules_live(spark, sf_dir))


_AFTER_UNBLOCK_COLS = COLS.replace("src_ip,", "r.src_ip,", 1).replace(
    "expiry_us", "CASE WHEN r.expiry_us IS NOT NULL AND ub.last_u >= r.added_at_us THEN ub.last_u"
                 " ELSE r.expiry_us END AS expiry_us")


@query("rules_after_unblock", rsql(f"""
SELECT {_AFTER_UNBLOCK_COLS} FROM rules r
LEFT JOIN (SELECT src_ip, max(ts_us) AS last_u FROM packets WHERE dst_port = 443 AND label = 'BENIGN'
           GROUP BY src_ip) ub ON ub.src_ip = r.src_ip""", PERMANENT_TTL))
def rules_after_unblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unblocks move the expiry of every timed rule that existed."""
    return R.apply_unblocks(rules_mixed(spark, sf_dir), unblocks(spark, sf_dir)).select(*R.RULE_COLUMNS)


_FINAL_COLS = COLS.replace("src_ip,", "r.src_ip,", 1).replace(
    "expiry_us", "CASE WHEN r.expiry_us IS NOT NULL THEN m.last END AS expiry_us")


@query("rules_final_state", rsql(f"""
SELECT {_FINAL_COLS} FROM rules r
LEFT JOIN (SELECT src_ip, max(expiry_us) AS last FROM rules WHERE expiry_us IS NOT NULL GROUP BY src_ip) m
  ON m.src_ip = r.src_ip""", PERMANENT_TTL))
def rules_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table state once every TTL timer has fired."""
    return R.after_timers(rules_mixed(spark, sf_dir)).select(*R.RULE_COLUMNS)


@query("active_rules_asof", rsql(
    f"SELECT {COLS} FROM rules WHERE added_at_us <= (SELECT max(ts_us) FROM packets) - 86400000000"
    " AND (expiry_us IS NULL OR expiry_us > (SELECT max(ts_us) FROM packets) - 86400000000)", PERMANENT_TTL))
def active_rules_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules live one day before the last packet."""
    t = fx.packets(spark, sf_dir).agg(F.max("ts_us") - 86_400_000_000).first()[0]  # one number
    return R.active_at(rules_mixed(spark, sf_dir), F.lit(t).cast("long")).select(*R.RULE_COLUMNS)


INTERVALS_SQL = """, iv0 AS (SELECT src_ip, added_at_us AS s, coalesce(expiry_us, 4611686018427387904) AS e, rule_id FROM rules),
iv1 AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY src_ip ORDER BY s, e, rule_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL OR s > max(e) OVER (PARTITION BY src_ip ORDER BY s, e, rule_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM iv0),
iv2 AS (SELECT *, sum(nw) OVER (PARTITION BY src_ip ORDER BY s, e, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM iv1),
iv AS (SELECT src_ip, min(s) AS start_us, CASE WHEN max(e) < 4611686018427387904 THEN max(e) END AS end_us,
  count(*)::BIGINT AS n_rules FROM iv2 GROUP BY src_ip, isl)"""


@query("blocked_intervals", fx.with_views(f"WITH {_rules_sql(PERMANENT_TTL)}{INTERVALS_SQL}\nSELECT * FROM iv", "packets", "votes"))
def blocked_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint blocked intervals per source address."""
    return R.blocked_intervals(rules_mixed(spark, sf_dir))


def _flows_sql_with_rules(body: str) -> str:
    flow_cte = FL._flow_rows_sql(FL.TIMEOUT_S)  # starts with WITH RECURSIVE p AS (...)
    sql = flow_cte + ",\n" + _rules_sql(PERMANENT_TTL) + "\n" + body
    return fx.with_views(sql, "packets", "votes")


_BLOCKED = """EXISTS (SELECT 1 FROM rules r WHERE r.src_ip = a.src_ip AND r.added_at_us <= a.start_us
  AND (r.expiry_us IS NULL OR a.start_us < r.expiry_us))"""


@query("blocked_flows", _flows_sql_with_rules(
    f"SELECT a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.protocol, a.seg_no, a.start_us FROM agg a WHERE {_BLOCKED}"))
def blocked_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed flows whose source was blocked when the flow started."""
    f = FL._flows(spark, sf_dir).select(*FL.KEY5, "seg_no", "start_us")
    return R.mark_blocked(f, rules_mixed(spark, sf_dir)).where("blocked").drop("blocked")


@query("allowed_flows", _flows_sql_with_rules(
    f"SELECT a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.protocol, a.seg_no, a.start_us FROM agg a WHERE NOT {_BLOCKED}"))
def allowed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed flows let through (no live rule for their source)."""
    f = FL._flows(spark, sf_dir).select(*FL.KEY5, "seg_no", "start_us")
    return R.mark_blocked(f, rules_mixed(spark, sf_dir)).where(~F.col("blocked")).drop("blocked")


def flow_log_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 rows: (timestamp_us, 5-tuple, prediction text, decision) per flow."""
    d = FL.flagship(spark, sf_dir)
    return d.select(F.col("close_id").alias("id"), F.col("end_us").alias("timestamp_us"), *FL.KEY5, "prediction", "decision")


@query("flow_log", fx.with_views(FL._flow_rows_sql(FL.TIMEOUT_S) + """,
v AS (SELECT *, CASE WHEN bytes > 400 THEN 1 ELSE 0 END AS pred_rf,
        CASE WHEN f_syn > 0 THEN 1 ELSE 0 END AS pred_lr,
        CASE WHEN (CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END) < 3600 THEN 1 ELSE 0 END AS pred_mlp
      FROM agg)
SELECT close_id AS id, end_us AS timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol,
  '{"rf":' || pred_rf || ',"lr":' || pred_lr || ',"mlp":' || pred_mlp || '}' AS prediction,
  CASE WHEN pred_rf + pred_lr + pred_mlp > 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision
FROM v""", "packets"))
def flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the flow-decision log rows."""
    return flow_log_df(spark, sf_dir)


@query("latest_decisions", fx.with_views(FL._flow_rows_sql(FL.TIMEOUT_S) + """,
v AS (SELECT *, CASE WHEN bytes > 400 THEN 1 ELSE 0 END AS pred_rf,
        CASE WHEN f_syn > 0 THEN 1 ELSE 0 END AS pred_lr,
        CASE WHEN (CASE WHEN iat_n > 0 THEN iat_sum::DOUBLE / iat_n / 1000000.0 ELSE 0 END) < 3600 THEN 1 ELSE 0 END AS pred_mlp
      FROM agg)
SELECT close_id AS id, end_us AS timestamp_us, src_ip, dst_ip, src_port, dst_port, protocol,
  '{"rf":' || pred_rf || ',"lr":' || pred_lr || ',"mlp":' || pred_mlp || '}' AS prediction,
  CASE WHEN pred_rf + pred_lr + pred_mlp > 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision
FROM v QUALIFY row_number() OVER (ORDER BY end_us DESC, close_id DESC) <= 100""", "packets"))
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the newest 100 flow decisions by time (a feed, newest first)."""
    return SM.latest(flow_log_df(spark, sf_dir), "timestamp_us", 100, tie="id")
