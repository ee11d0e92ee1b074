"""Views over the driver tables (FIXTURES.md part 2).

Every registered query reads the driver's parquet tables through these
views, so its work grows with the tables.  Each view exists twice: as a
Spark DataFrame builder and as DuckDB SQL text (a CTE body) used by the
oracle queries.  Both produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Microseconds since the epoch from a TIMESTAMP_NTZ column, built from date
# parts so the session time zone cannot shift it.
_TS_US_SPARK = (
    "unix_date(CAST(ts AS DATE)) * 86400000000L + hour(ts) * 3600000000L"
    " + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"
)

_PACKET_COLS = [
    "CAST(event_id AS BIGINT) AS id",
    "{ts} AS ts_us",
    "concat('10.0.0.', CAST(user_id % 16 AS STRING)) AS src_ip",
    "concat('192.168.0.', CAST(event_id % 2 AS STRING)) AS dst_ip",
    "CAST(1024 + (user_id % 16) AS INT) AS src_port",
    "CAST(CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 ELSE 53 END AS INT) AS dst_port",
    "CAST(CASE WHEN event_type IN ('click','view') THEN 6 ELSE 17 END AS INT) AS protocol",
    "CAST(floor(value * 3) + 40 AS INT) AS length",
    "CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 24 ELSE 0 END AS INT) AS tcp_flags",
    "CASE WHEN event_type = 'error' THEN 'DDoS' ELSE 'BENIGN' END AS label",
]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packets(id, ts_us, src_ip, dst_ip, src_port, dst_port, protocol,
    length, tcp_flags, label) over ``events``; id is the arrival order."""
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(*[c.format(ts=_TS_US_SPARK) for c in _PACKET_COLS])


PACKETS_SQL = "SELECT " + ", ".join(
    c.format(ts="epoch_us(ts)").replace("CAST(user_id % 16 AS STRING)", "CAST(user_id % 16 AS VARCHAR)")
    .replace("CAST(event_id % 2 AS STRING)", "CAST(event_id % 2 AS VARCHAR)")
    for c in _PACKET_COLS
) + " FROM events"


# Deterministic stand-ins for three model outputs (FIXTURES.md "Votes").
_VOTE_COLS = [
    "CAST(event_id AS BIGINT) AS row_id",
    "CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS INT) AS pred_rf",
    "CAST(CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END AS INT) AS pred_lr",
    "CAST(CASE WHEN event_type IN ('error','click') THEN 1 ELSE 0 END AS INT) AS pred_mlp",
    "CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INT) AS y_true",
    "CAST((event_id % 50 + 50) / 100.0 AS DOUBLE) AS conf_rf",
    "CAST(CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 40 + 60) / 100.0 END AS DOUBLE) AS conf_lr",
    "CAST(CASE WHEN event_type = 'purchase' THEN NULL ELSE (event_id % 30 + 70) / 100.0 END AS DOUBLE) AS conf_mlp",
    "CAST(event_id DIV 3000 AS BIGINT) AS chunk_no",
    "CAST(event_id % 3000 AS BIGINT) AS row_in_chunk",
]


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_VOTE_COLS)


VOTES_SQL = "SELECT " + ", ".join(c.replace(" DIV ", " // ") for c in _VOTE_COLS) + " FROM events"


# A CICIDS-layout flow table with messy headers and label spellings, for the
# cleaning operators.  Spark gets the raw header names (leading blanks as in
# the public CSVs); the SQL view uses the stripped names.
_RAW_FLOW_COLS = [
    ("Flow ID", "concat(CAST(event_id AS STRING), '-', CAST(user_id AS STRING))"),
    (" Source IP", "concat('10.0.0.', CAST(user_id % 16 AS STRING))"),
    (" Source Port", "CAST(1024 + (user_id % 16) AS INT)"),
    (" Destination IP", "concat('192.168.0.', CAST(event_id % 2 AS STRING))"),
    (" Destination Port", "CAST(CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 ELSE 53 END AS INT)"),
    (" Protocol", "CAST(CASE WHEN event_type IN ('click','view') THEN 6 ELSE 17 END AS INT)"),
    (" Timestamp", "CAST(event_id AS DOUBLE)"),
    (" Flow Duration", "CAST(floor(value * 1000) AS BIGINT)"),
    ("Total Length of Fwd Packets", "CAST(floor(value * 3) + 40 AS DOUBLE)"),
    (" Flow Bytes/s", "CASE WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE)"
                     " WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE)"
                     " WHEN event_id % 19 = 0 THEN NULL ELSE value * 10 END"),
    (" Flow Packets/s", "CASE WHEN event_id % 23 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value / 7 END"),
    ("row_id", "CAST(event_id AS BIGINT)"),
    (" Label", "CASE event_type WHEN 'view' THEN 'BENIGN' WHEN 'click' THEN 'benign'"
               " WHEN 'signup' THEN ' BENIGN ' WHEN 'error' THEN 'DDoS'"
               " ELSE CASE WHEN value > 100 THEN 'PortScan' WHEN value > 50 THEN '' ELSE NULL END END"),
]


def raw_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(*[F.expr(e).alias(n) for n, e in _RAW_FLOW_COLS])


def _duck(e: str) -> str:
    return (e.replace("AS STRING", "AS VARCHAR").replace("CAST('Infinity' AS DOUBLE)", "'Infinity'::DOUBLE")
             .replace("CAST('-Infinity' AS DOUBLE)", "'-Infinity'::DOUBLE").replace("CAST('NaN' AS DOUBLE)", "'NaN'::DOUBLE"))


RAW_FLOWS_SQL = "SELECT " + ", ".join(
    f'{_duck(e)} AS "{n.strip()}"' for n, e in _RAW_FLOW_COLS) + " FROM events"


# Live packets as a capture layer would hand them over: separate TCP and UDP
# port fields, non-IP frames with NULL addresses.  'purchase' events stand in
# for non-IP frames, 'signup' for UDP, the rest for TCP.
_LIVE_COLS = [
    "CAST(event_id AS BIGINT) AS id",
    "{ts} AS ts_us",
    "CASE WHEN event_type = 'purchase' THEN NULL ELSE concat('10.0.0.', CAST(user_id % 16 AS STRING)) END AS src_ip",
    "CASE WHEN event_type = 'purchase' THEN NULL ELSE concat('192.168.0.', CAST(event_id % 2 AS STRING)) END AS dst_ip",
    "CAST(CASE WHEN event_type IN ('click','view','error') THEN 1024 + (user_id % 16) END AS INT) AS tcp_sport",
    "CAST(CASE WHEN event_type IN ('click','view','error') THEN CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 ELSE 8080 END END AS INT) AS tcp_dport",
    "CAST(CASE WHEN event_type = 'signup' THEN 2048 + (user_id % 16) END AS INT) AS udp_sport",
    "CAST(CASE WHEN event_type = 'signup' THEN 53 END AS INT) AS udp_dport",
    "CAST(CASE WHEN event_type = 'purchase' THEN NULL WHEN event_type = 'signup' THEN 17 ELSE 6 END AS INT) AS protocol",
    "CAST(floor(value * 3) + 40 AS INT) AS length",
    "CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 24 WHEN 'error' THEN 17 ELSE 0 END AS INT) AS tcp_flags",
]


def live_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[c.format(ts=_TS_US_SPARK) for c in _LIVE_COLS])


LIVE_PACKETS_SQL = "SELECT " + ", ".join(_duck(c.format(ts="epoch_us(ts)")) for c in _LIVE_COLS) + " FROM events"


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named fixture views as CTEs."""
    bodies = {"packets": PACKETS_SQL, "votes": VOTES_SQL, "raw_flows": RAW_FLOWS_SQL,
              "live_packets": LIVE_PACKETS_SQL}
    ctes = ",\n".join(f"{n} AS ({bodies[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[len('WITH RECURSIVE '):]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
