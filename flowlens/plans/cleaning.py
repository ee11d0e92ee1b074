"""Cleaning, projection and packet-field queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import packets as PK
from flowlens.operators import clean as C
from flowlens.operators import packets as PO
from flowlens.plans.registry import query
from flowlens.sources import fixtures as fx

LABELS_SQL_NOTNULL = "Label IS NOT NULL AND Label <> ''"


@query("clean_labels", fx.with_views(f"""
SELECT row_id, CASE WHEN upper(Label) = 'BENIGN' THEN 'BENIGN' ELSE 'ATTACK' END AS Label
FROM raw_flows WHERE {LABELS_SQL_NOTNULL}""", "raw_flows"))
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped headers, rows without label dropped, BENIGN/ATTACK."""
    return C.clean_labels(fx.raw_flows(spark, sf_dir)).select("row_id", "Label")


@query("binary_label_exact", fx.with_views("""
SELECT row_id, Label, CASE WHEN Label = 'BENIGN' THEN 0 ELSE 1 END AS y FROM raw_flows""", "raw_flows"))
def binary_label_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: exact, case-sensitive BENIGN -> 0, anything else (NULL too) -> 1."""
    df = C.strip_headers(fx.raw_flows(spark, sf_dir))
    return C.binary_label(df, "Label", "exact").select("row_id", "Label", "y")


@query("binary_label_contains", fx.with_views("""
SELECT row_id, Label, CASE WHEN contains(upper(trim(Label)), 'BENIGN') THEN 0 ELSE 1 END AS y
FROM raw_flows""", "raw_flows"))
def binary_label_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6: 'BENIGN' anywhere in the trimmed upper-cased label -> 0, else 1."""
    df = C.strip_headers(fx.raw_flows(spark, sf_dir))
    return C.binary_label(df, "Label", "contains").select("row_id", "Label", "y")


_NUM = ('"Flow Duration"', '"Total Length of Fwd Packets"', '"Flow Bytes/s"', '"Flow Packets/s"')


def _fz(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}"


@query("finite_or_zero", fx.with_views(f"""
SELECT row_id, coalesce("Flow Duration", 0) AS "Flow Duration",
  {_fz('"Total Length of Fwd Packets"')}, {_fz('"Flow Bytes/s"')}, {_fz('"Flow Packets/s"')}
FROM raw_flows""", "raw_flows"))
def finite_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+-inf, NaN and NULL -> 0 in every numeric column but the label."""
    df = C.finite_or_zero(C.strip_headers(fx.raw_flows(spark, sf_dir)))
    return df.select("row_id", "Flow Duration", "Total Length of Fwd Packets", "Flow Bytes/s", "Flow Packets/s")


@query("downcast", fx.with_views(f"""
WITH z AS (SELECT row_id, "Flow Duration", {_fz('"Flow Bytes/s"')}, {_fz('"Flow Packets/s"')}, Label FROM raw_flows)
SELECT row_id, CAST("Flow Duration" AS INTEGER) AS "Flow Duration",
  CAST(CAST("Flow Bytes/s" AS FLOAT) AS DOUBLE) AS "Flow Bytes/s",
  CAST(CAST("Flow Packets/s" AS FLOAT) AS DOUBLE) AS "Flow Packets/s",
  CAST(CASE WHEN Label = 'BENIGN' THEN 0 ELSE 1 END AS TINYINT) AS Label
FROM z""", "raw_flows"))
def downcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOUBLE -> FLOAT, BIGINT -> INT, label -> TINYINT (floats shown
    cast back to DOUBLE so both engines print them alike)."""
    df = C.strip_headers(fx.raw_flows(spark, sf_dir)).select(
        "row_id", "Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Label")
    d = C.downcast(C.finite_or_zero(df), keep=("row_id",))
    return d.withColumns({c: F.col(f"`{c}`").cast("double") for c in ("Flow Bytes/s", "Flow Packets/s")})


@query("drop_identifiers", fx.with_views(f"""
SELECT "Source IP", "Source Port", "Destination IP", "Destination Port", Protocol, "Flow Duration",
  {_fz('"Total Length of Fwd Packets"')}, {_fz('"Flow Bytes/s"')}, {_fz('"Flow Packets/s"')}, row_id, Label
FROM raw_flows""", "raw_flows"))
def drop_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 (+P7): identifier columns dropped where present, the rest kept."""
    return C.drop_identifiers(C.finite_or_zero(C.strip_headers(fx.raw_flows(spark, sf_dir))))


# Fixed value: the required feature list used by the alignment query.
REQUIRED = ["Destination Port", "Flow Duration", "Fwd Header Length", "Total Length of Fwd Packets",
            "Protocol"]


@query("align_features", fx.with_views("""
SELECT row_id, "Destination Port", "Flow Duration", 0 AS "Fwd Header Length",
  "Total Length of Fwd Packets", Protocol FROM raw_flows""", "raw_flows"))
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label dropped, missing required columns as 0, extras dropped, ordered."""
    df = C.strip_headers(fx.raw_flows(spark, sf_dir))
    return C.align_features(df, REQUIRED, keep=["row_id"])


@query("union_by_name", fx.with_views("""
SELECT row_id, "Destination Port", "Flow Duration", Label FROM raw_flows
UNION ALL BY NAME
SELECT id AS row_id, length AS "Total Length of Fwd Packets", tcp_dport AS "Destination Port" FROM live_packets""",
                                       "raw_flows", "live_packets"))
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flow tables with different columns, stacked by name."""
    a = C.strip_headers(fx.raw_flows(spark, sf_dir)).select("row_id", "Destination Port", "Flow Duration", "Label")
    b = fx.live_packets(spark, sf_dir).select(F.col("id").alias("row_id"),
                                              F.col("length").alias("Total Length of Fwd Packets"),
                                              F.col("tcp_dport").alias("Destination Port"))
    return C.union_by_name([a, b])


@query("flow_row_projection", fx.with_views("""
SELECT row_id, "Source IP" AS src_ip, "Destination IP" AS dst_ip,
  CAST(coalesce("Source Port", 0) AS INTEGER) AS src_port, CAST(coalesce("Destination Port", 0) AS INTEGER) AS dst_port,
  CASE WHEN Protocol = 6 THEN 6 ELSE 17 END AS protocol,
  CAST(coalesce("Total Length of Fwd Packets", 0) AS DOUBLE) AS length,
  CAST(coalesce("Timestamp", 0) AS DOUBLE) AS timestamp, trim(Label) AS label
FROM raw_flows""", "raw_flows"))
def flow_row_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-CSV row -> packet-like row with defaults for absent columns."""
    df = C.strip_headers(fx.raw_flows(spark, sf_dir))
    return PO.flow_row_projection(df, keep=["row_id"])


@query("packet_projection", fx.with_views("""
SELECT id, ts_us, src_ip, dst_ip, coalesce(tcp_sport, udp_sport) AS src_port,
  coalesce(tcp_dport, udp_dport) AS dst_port, protocol, length FROM live_packets""", "live_packets"))
def packet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture-layer packets -> packets table; non-IP kept with NULLs."""
    return PO.packet_projection(fx.live_packets(spark, sf_dir))


@query("live_packet_projection", fx.with_views("""
SELECT id, ts_us, src_ip, dst_ip, coalesce(tcp_sport, udp_sport, 0) AS src_port,
  coalesce(tcp_dport, udp_dport, 0) AS dst_port, protocol, length, tcp_flags
FROM live_packets WHERE src_ip IS NOT NULL""", "live_packets"))
def live_packet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-IP frames dropped, ports TCP -> UDP -> 0."""
    return PO.live_packet_projection(fx.live_packets(spark, sf_dir))


@query("packet_features", fx.with_views("""
WITH pk AS (SELECT id, src_ip, dst_ip, coalesce(tcp_sport, udp_sport) AS src_port,
  coalesce(tcp_dport, udp_dport) AS dst_port, protocol, length FROM live_packets)
SELECT id, CAST(coalesce(src_port, 0) AS INTEGER) AS src_port, CAST(coalesce(dst_port, 0) AS INTEGER) AS dst_port,
  CAST(coalesce(protocol, 0) AS INTEGER) AS protocol, CAST(coalesce(length, 0) AS INTEGER) AS length,
  coalesce(try_cast(split_part(src_ip, '.', -1) AS INTEGER), 0) AS src_ip_octet,
  coalesce(try_cast(split_part(dst_ip, '.', -1) AS INTEGER), 0) AS dst_ip_octet
FROM pk""", "live_packets"))
def packet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer packet features with NULL -> 0 and last IP octets."""
    return PO.packet_features(PO.packet_projection(fx.live_packets(spark, sf_dir)), keep=["id"])


@query("valid_ip", """
WITH c AS (SELECT event_id AS id,
  '10.' || CAST(user_id % 300 AS VARCHAR) || '.0.' || CAST(event_id % 260 AS VARCHAR) AS ip FROM events)
SELECT id, ip,
  coalesce(regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])'), false) AS valid
FROM c""")
def valid_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 (IPv4 half): dotted quads with octets 0-255 and no leading zeros."""
    ev = fx.table(spark, sf_dir, "events")
    c = ev.select(F.col("event_id").alias("id"),
                  F.concat(F.lit("10."), (F.col("user_id") % 300).cast("string"), F.lit(".0."),
                           (F.col("event_id") % 260).cast("string")).alias("ip"))
    return c.select("id", "ip", PK.is_valid_ipv4("ip").alias("valid"))


# Forms of IPv6 text by event id (n = user_id % 15 + 1, m = event_id): the text
# and, as SQL, its canonical form (NULL where the text is no address).
_V6_FORMS = [
    ("concat('2001:DB8:0:0:', n16, ':0:0:', m16)", "concat('2001:db8::', n16, ':0:0:', m16)"),
    ("concat('FE80::0', n16, ':', m16)", "concat('fe80::', n16, ':', m16)"),
    ("concat('0:0:0:', n16, ':0:0:0:0')", "concat('0:0:0:', n16, '::')"),
    ("concat('2001:db8:0:1:', n16, ':0001:1:', m16)", "concat('2001:db8:0:1:', n16, ':1:1:', m16)"),
    ("concat('2001:db8::', n16, '::1')", "NULL"),
    ("concat('::ffff:10.0.', n10, '.7')", "concat('::ffff:a00:', n16, '07')"),
    ("concat(n16, ':', m16, ':3:4:5:6:7')", "NULL"),
    ("concat('::', n16, ':12345')", "NULL"),
    ("concat('10.0.', n10, '.1')", "concat('10.0.', n10, '.1')"),
    ("'::'", "'::'"),
]


@query("valid_ip_v6", f"""
WITH e AS (SELECT event_id AS id, CAST(user_id % 15 + 1 AS VARCHAR) AS n10, printf('%x', user_id % 15 + 1) AS n16,
  printf('%x', event_id % 65535 + 1) AS m16, event_id % {len(_V6_FORMS)} AS form FROM events)
SELECT id, CASE form {" ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_V6_FORMS))} END AS ip,
  CASE form {" ".join(f"WHEN {i} THEN {c}" for i, (_, c) in enumerate(_V6_FORMS))} END AS ip_canonical FROM e""")
def valid_ip_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical IPv6 (and IPv4) text, NULL for what is no address."""
    e = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "CAST(user_id % 15 + 1 AS STRING) AS n10", "lower(hex(user_id % 15 + 1)) AS n16",
        "lower(hex(event_id % 65535 + 1)) AS m16", f"event_id % {len(_V6_FORMS)} AS form")
    forms = " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_V6_FORMS))
    return PK.canonical_ip(e.selectExpr("id", f"CASE form {forms} END AS ip"), "ip")


@query("incremental_packets", fx.with_views("""
SELECT * FROM packets WHERE id > -1""", "packets"))
def incremental_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets after the high-water mark (-1, the first call), by id."""
    rows, _ = PO.fetch_new_packets(fx.packets(spark, sf_dir), last_id=-1)
    return rows


@query("incremental_high_water", fx.with_views("""
SELECT coalesce(max(id), -1)::BIGINT AS last_id, count(*)::BIGINT AS n_new FROM packets WHERE id > -1""", "packets"))
def incremental_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new high-water mark (unchanged when nothing is new)."""
    _, hw = PO.fetch_new_packets(fx.packets(spark, sf_dir), last_id=-1)
    return hw
