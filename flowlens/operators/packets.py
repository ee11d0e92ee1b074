"""Packet-table operators: capture projection, live projection, features,
incremental scans."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import packets as PK

# Defaults for flow-CSV columns that are absent.
FLOW_ROW_DEFAULTS = {
    "Source IP": ("src_ip", "0.0.0.0"),
    "Destination IP": ("dst_ip", "0.0.0.0"),
    "Source Port": ("src_port", 0),
    "Destination Port": ("dst_port", 0),
    "Protocol": ("protocol", 6),
    "Total Length of Fwd Packets": ("length", 0.0),
    "Timestamp": ("timestamp", 0.0),
}


def packet_projection(raw: DataFrame) -> DataFrame:
    """7 packet fields; ports from TCP, else UDP, else NULL; frames
    without IP keep NULL addresses."""
    return raw.select("id", "ts_us", "src_ip", "dst_ip",
                      PK.port_of("tcp_sport", "udp_sport", None).alias("src_port"),
                      PK.port_of("tcp_dport", "udp_dport", None).alias("dst_port"),
                      "protocol", "length")


def live_packet_projection(raw: DataFrame) -> DataFrame:
    """Only IP packets; ports TCP -> UDP -> 0."""
    return (raw.where(F.col("src_ip").isNotNull())
               .select("id", "ts_us", "src_ip", "dst_ip",
                       PK.port_of("tcp_sport", "udp_sport", 0).alias("src_port"),
                       PK.port_of("tcp_dport", "udp_dport", 0).alias("dst_port"),
                       "protocol", "length", "tcp_flags"))


def packet_features(pk: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Integer features, NULL -> 0, last octets of both addresses."""
    return pk.select(*keep,
                     PK.int_or_zero("src_port").alias("src_port"),
                     PK.int_or_zero("dst_port").alias("dst_port"),
                     PK.int_or_zero("protocol").alias("protocol"),
                     PK.int_or_zero("length").alias("length"),
                     PK.last_octet("src_ip").alias("src_ip_octet"),
                     PK.last_octet("dst_ip").alias("dst_ip_octet"))


def flow_row_projection(df: DataFrame, keep: Sequence[str] = (), label_col: str = "Label") -> DataFrame:
    """Flow-CSV row -> (src_ip, dst_ip, src_port, dst_port, protocol,
    length, timestamp, label); absent columns take their defaults, NULL
    ports become 0 and the protocol is 6 if it is 6, else 17."""
    cols = list(keep)
    for src, (name, default) in FLOW_ROW_DEFAULTS.items():
        c = F.col(f"`{src}`") if src in df.columns else F.lit(default)
        if name in ("src_port", "dst_port"):
            c = F.coalesce(c, F.lit(0)).cast("int")
        elif name == "protocol":
            c = PK.protocol_tcp_or_udp(src) if src in df.columns else F.lit(6)
        elif name in ("length", "timestamp"):
            c = F.coalesce(c.cast("double"), F.lit(0.0))
        cols.append(c.alias(name))
    lab = F.trim(F.col(label_col)) if label_col in df.columns else F.lit("BENIGN")
    return df.select(*cols, lab.alias("label"))


def fetch_new_packets(packets: DataFrame, last_id: int = -1) -> tuple[DataFrame, DataFrame]:
    """Rows with ``id > last_id`` in id order, and the new high-water
    mark (``last_id`` again when nothing is new).  Ids begin at 0, so the
    mark before any packet is -1.  The id predicate is pushed
    into the Parquet scan."""
    new = packets.where(F.col("id") > F.lit(last_id))
    hw = new.agg(F.coalesce(F.max("id"), F.lit(last_id)).cast("long").alias("last_id"),
                 F.count(F.lit(1)).alias("n_new"))
    return new.orderBy("id"), hw
