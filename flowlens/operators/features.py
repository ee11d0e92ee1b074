"""Per-flow aggregates and the two 78-slot feature layouts.

One ``groupBy(key, seg_no)`` computes ~35 base measures (map-side partial
aggregation, so the shuffle after the sweep carries partial rows per flow);
the 78 slots are then a cheap projection.  Keeping the aggregate narrow also
keeps it under the whole-stage-codegen method size limit.

Numerical conventions (fixed by the feature definitions):
* length stats over an empty direction are 1e-6 for mean, std, min and max;
* inter-arrival stats of a flow with < 2 packets are 0 (the gap list is [0]);
* std is the population std; times are seconds (DOUBLE).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.packets import FLAG_NAMES, flag_bit
from flowlens.operators.scan import few
from flowlens.operators.segment import KEY5
from flowlens.session import reliable_checkpoint

EMPTY_STAT = 1e-6
# Column-metadata tag naming the slot layout of f0..f77 (models remember it).
LAYOUT_KEY = "flowlens.layout"
LAYOUT_FLOW78 = "flow78"
LAYOUT_CICIDS = "cicids"
US = 1_000_000.0


def direction_column(direction: str = "directed", live: bool = False) -> Column:
    """Forward iff the packet has the source of the flow's first packet.

    ``directed``: the key contains the source, so every packet is forward.
    ``bidirectional``: needs ``anchor_src_ip`` (and ``anchor_src_port`` when
    ``live``) from :func:`segment_flows`.
    """
    if direction == "directed":
        return F.lit(True)
    same = F.col("src_ip").eqNullSafe(F.col("anchor_src_ip"))
    if live:
        same = same & F.col("src_port").eqNullSafe(F.col("anchor_src_port"))
    return same


def bidirectional_key(df: DataFrame) -> DataFrame:
    """Canonical endpoints so both directions of a conversation share a key."""
    a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("int").alias("port"))
    b = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").cast("int").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return df.withColumns({
        "ep_lo_ip": lo["ip"], "ep_lo_port": lo["port"],
        "ep_hi_ip": hi["ip"], "ep_hi_port": hi["port"],
    })


BIDIR_KEY = ("ep_lo_ip", "ep_lo_port", "ep_hi_ip", "ep_hi_port", "protocol")


def flow_aggregates(segmented: DataFrame, key: Sequence[str] = KEY5, direction: str = "directed",
                    live: bool = False, with_label: bool = True, with_flags: bool = True,
                    order_col: str = "id") -> DataFrame:
    """Base measures per flow: one row per (key, seg_no)."""
    fwd = direction_column(direction, live)
    df = segmented.withColumn("_fwd", fwd)
    ln = F.col("length")
    fl = F.when(F.col("_fwd"), ln)
    bl = F.when(~F.col("_fwd"), ln)
    aggs = [
        F.count(F.lit(1)).alias("n_pkts"),
        F.count(fl).alias("fwd_pkts"),
        F.count(bl).alias("bwd_pkts"),
        F.coalesce(F.sum(fl.cast("long")), F.lit(0).cast("long")).alias("fwd_bytes"),
        F.coalesce(F.sum(bl.cast("long")), F.lit(0).cast("long")).alias("bwd_bytes"),
        F.min(fl).alias("fwd_len_min"), F.max(fl).alias("fwd_len_max"),
        F.stddev_pop(fl).alias("fwd_len_std"),
        F.min(bl).alias("bwd_len_min"), F.max(bl).alias("bwd_len_max"),
        F.stddev_pop(bl).alias("bwd_len_std"),
        F.min("ln_all").alias("len_min"), F.max("ln_all").alias("len_max"),
        F.stddev_pop("ln_all").alias("len_std"), F.var_pop("ln_all").alias("len_var"),
        F.min("start_us").alias("start_us"),
        F.max_by("ts_us", order_col).alias("end_us"),
        F.count("iat_us").alias("iat_n"), F.sum("iat_us").alias("iat_sum"),
        F.min("iat_us").alias("iat_min"), F.max("iat_us").alias("iat_max"),
        F.stddev_pop("iat_us").alias("iat_std"),
        F.bool_or("closes").alias("closed"),
        F.min(order_col).alias("first_id"),
        F.max(order_col).alias("close_id"),
    ]
    if with_flags:
        for name in FLAG_NAMES:
            bit = flag_bit(name)
            aggs.append(F.sum(F.when(F.col("_fwd"), bit).otherwise(0)).alias(f"fwd_{name.lower()}"))
            aggs.append(F.sum(F.when(~F.col("_fwd"), bit).otherwise(0)).alias(f"bwd_{name.lower()}"))
    if with_label and "_label_code" in segmented.columns:
        aggs.append(F.max_by("_label_code", order_col).alias("_label_code"))
    elif with_label:
        aggs.append(F.max_by("label", order_col).alias("label"))
    for c in ("anchor_src_ip", "anchor_src_port"):
        if c in segmented.columns:
            aggs.append(F.first(c).alias(c))
    if "anchor_dst_port" in segmented.columns:
        aggs.append(F.first("anchor_dst_port").alias("dst_port"))
    if direction == "directed":
        # every packet is forward: the per-direction gaps are the flow gaps
        out = df.withColumn("ln_all", ln).groupBy(*key, "seg_no").agg(*aggs)
        none = F.lit(None).cast("long")
        return out.withColumns({
            "fwd_iat_n": F.col("iat_n"), "fwd_iat_sum": F.col("iat_sum"), "fwd_iat_min": F.col("iat_min"),
            "fwd_iat_max": F.col("iat_max"), "fwd_iat_std": F.col("iat_std"),
            "bwd_iat_n": F.lit(0).cast("long"), "bwd_iat_sum": none, "bwd_iat_min": none,
            "bwd_iat_max": none, "bwd_iat_std": F.lit(None).cast("double")})
    # both directions: gap to the previous packet of the same direction
    wdir = Window.partitionBy(*key, "seg_no", "_fwd").orderBy(order_col)
    df = df.withColumn("_dgap", F.col("ts_us") - F.lag("ts_us").over(wdir))
    for d, cond in (("fwd", F.col("_fwd")), ("bwd", ~F.col("_fwd"))):
        g = F.when(cond, F.col("_dgap"))
        aggs += [F.count(g).alias(f"{d}_iat_n"), F.sum(g).alias(f"{d}_iat_sum"), F.min(g).alias(f"{d}_iat_min"),
                 F.max(g).alias(f"{d}_iat_max"), F.stddev_pop(g).alias(f"{d}_iat_std")]
    return df.withColumn("ln_all", ln).groupBy(*key, "seg_no").agg(*aggs)


def _stat(v: Column, n: Column, empty) -> Column:
    return F.when(n > 0, v.cast("double")).otherwise(F.lit(empty))


def _mean(total: str, n: str, empty) -> Column:
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n)).otherwise(F.lit(empty))


def length_stats(flows: DataFrame) -> dict[str, Column]:
    """Safe stats of fwd/bwd lengths (1e-6 when the direction is empty)."""
    out = {}
    for d in ("fwd", "bwd"):
        n = F.col(f"{d}_pkts")
        out[f"{d}_len_mean"] = _mean(f"{d}_bytes", f"{d}_pkts", EMPTY_STAT)
        out[f"{d}_len_std"] = _stat(F.col(f"{d}_len_std"), n, EMPTY_STAT)
        out[f"{d}_len_min"] = _stat(F.col(f"{d}_len_min"), n, EMPTY_STAT)
        out[f"{d}_len_max"] = _stat(F.col(f"{d}_len_max"), n, EMPTY_STAT)
    return out


def iat_stats(flows: DataFrame) -> dict[str, Column]:
    """Inter-arrival stats in seconds; flows with < 2 packets give 0."""
    n = F.col("iat_n")
    return {
        "iat_mean": F.when(n > 0, F.col("iat_sum").cast("double") / n / US).otherwise(0.0),
        "iat_std": F.when(n > 0, F.col("iat_std") / US).otherwise(0.0),
        "iat_max": F.when(n > 0, F.col("iat_max") / US).otherwise(0.0),
        "iat_min": F.when(n > 0, F.col("iat_min") / US).otherwise(0.0),
    }


def flow_features_78(flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 78-slot live/offline layout as DOUBLE columns f0..f77."""
    ls = length_stats(flows)
    it = iat_stats(flows)
    fwd_p, bwd_p = F.col("fwd_pkts").cast("double"), F.col("bwd_pkts").cast("double")
    fwd_b, bwd_b = F.col("fwd_bytes").cast("double"), F.col("bwd_bytes").cast("double")
    zero = F.lit(0.0)
    slots: list[Column] = [zero] * 78
    slots[0] = F.col("dst_port").cast("double")
    slots[1] = (F.col("end_us") - F.col("start_us")) / US
    slots[2], slots[3], slots[4], slots[5] = fwd_p, bwd_p, fwd_b, bwd_b
    slots[6], slots[7], slots[8], slots[9] = ls["fwd_len_max"], ls["fwd_len_min"], ls["fwd_len_mean"], ls["fwd_len_std"]
    slots[10], slots[11], slots[12], slots[13] = ls["bwd_len_max"], ls["bwd_len_min"], ls["bwd_len_mean"], ls["bwd_len_std"]
    slots[14] = fwd_b + bwd_b
    slots[15] = fwd_p + bwd_p
    slots[16], slots[17], slots[18], slots[19] = it["iat_mean"], it["iat_std"], it["iat_max"], it["iat_min"]
    for i, name in enumerate(FLAG_NAMES):
        slots[42 + i] = F.col(f"fwd_{name.lower()}").cast("double")
        slots[48 + i] = F.col(f"bwd_{name.lower()}").cast("double")
    slots[54], slots[55], slots[56], slots[57] = ls["fwd_len_min"], ls["fwd_len_max"], ls["fwd_len_mean"], ls["fwd_len_std"]
    slots[58], slots[59], slots[60], slots[61] = ls["bwd_len_min"], ls["bwd_len_max"], ls["bwd_len_mean"], ls["bwd_len_std"]
    slots[62], slots[63], slots[64] = fwd_b, bwd_b, fwd_b + bwd_b
    slots[65], slots[66], slots[67] = fwd_p, bwd_p, fwd_p + bwd_p
    slots[68], slots[69], slots[70], slots[71] = it["iat_min"], it["iat_max"], it["iat_mean"], it["iat_std"]
    meta = {LAYOUT_KEY: LAYOUT_FLOW78}
    return flows.select(*keep, *[s.cast("double").alias(f"f{i}", metadata=meta) for i, s in enumerate(slots)])


FEATURE_NAMES = [f"f{i}" for i in range(78)]


def packet_flows(packets: DataFrame, timeout_s: float, key: Sequence[str] = KEY5,
                 direction: str = "directed", emit_open: bool = False, live: bool = False) -> DataFrame:
    """Packets -> one aggregate row per emitted flow (segmentation + A1-A4).

    One aggregate over (key, label) gives both the rows of each key, by which
    hot keys are split, and the distinct labels.  The text label rides through
    the sweep and the aggregate as a number of that label table (fixed-width
    buffers keep the aggregate hash-based instead of sort-based) and is decoded
    afterwards.  The table has one row per class name and is broadcast when
    its checked size allows.
    """
    # hot keys are segmented in parallel chunks, directed and bidirectional alike
    from flowlens.operators.hotkeys import segment_flows_split
    anchor = ("src_ip", "src_port", "dst_port") if direction != "directed" else ()
    if direction != "directed":
        packets = bidirectional_key(packets)
        key = BIDIR_KEY
    has_label = "label" in packets.columns
    labels = counts = None
    if has_label:
        profile = reliable_checkpoint(packets.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("_n")))
        counts = profile.groupBy(*key).agg(F.sum("_n").alias("_hn"))
        labels = few(reliable_checkpoint(profile.select(F.col("label").alias("_label")).distinct()
                                         .withColumn("_label_code", F.monotonically_increasing_id())))
        packets = packets.join(labels, packets["label"].eqNullSafe(labels["_label"])).drop("label", "_label")
    seg = segment_flows_split(packets, timeout_s, key=key, anchor_cols=anchor, counts=counts)
    flows = flow_aggregates(seg, key=key, direction=direction, live=live, with_label=has_label)
    if not emit_open:
        flows = flows.where("closed")
    if has_label:
        flows = flows.join(labels, "_label_code").drop("_label_code").withColumnRenamed("_label", "label")
    return flows
