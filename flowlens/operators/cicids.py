"""CICIDS-layout flow aggregates (78 slots in the public CICIDS2017 column order).

Computed from real packets of each flow, on top of :func:`flow_aggregates`:
rates are true per-second rates (0 for a zero-length flow), the flow IAT is
over the real interleaved gaps, per-direction IAT is over gaps between
packets of the same direction.  Slots that the layout fills with header or
window-size data that packets here do not carry are NULL; the bulk slots
are 0 and the minimum-segment slot is the constant 20 (fixed values of the
layout).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.features import LAYOUT_CICIDS, LAYOUT_KEY, US, iat_stats, length_stats

MIN_SEGMENT_SIZE = 20.0  # fixed value of the layout


def _dir_iat(flows: DataFrame, d: str) -> dict[str, Column]:
    """Per-direction IAT (gaps between packets of the same direction), in
    seconds; 0 when the direction has fewer than two packets."""
    n = F.col(f"{d}_iat_n")
    ok = n > 0
    return {
        "sum": F.when(ok, F.col(f"{d}_iat_sum") / US).otherwise(0.0),
        "mean": F.when(ok, F.col(f"{d}_iat_sum").cast("double") / n / US).otherwise(0.0),
        "std": F.when(ok, F.col(f"{d}_iat_std") / US).otherwise(0.0),
        "max": F.when(ok, F.col(f"{d}_iat_max") / US).otherwise(0.0),
        "min": F.when(ok, F.col(f"{d}_iat_min") / US).otherwise(0.0),
    }


def flow_features_cicids(flows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flow aggregates (directed or bidirectional) -> f0..f77 in CICIDS order."""
    ls = length_stats(flows)
    it = iat_stats(flows)
    fwd_p, bwd_p = F.col("fwd_pkts").cast("double"), F.col("bwd_pkts").cast("double")
    fwd_b, bwd_b = F.col("fwd_bytes").cast("double"), F.col("bwd_bytes").cast("double")
    dur = (F.col("end_us") - F.col("start_us")) / US
    per_s = lambda x: F.when(dur > 0, x / dur).otherwise(0.0)
    n_all = fwd_p + bwd_p
    b_all = fwd_b + bwd_b
    null = F.lit(None).cast("double")
    s: list[Column] = [null] * 78
    s[0] = F.col("dst_port").cast("double")
    s[1] = dur
    s[2], s[3], s[4], s[5] = fwd_p, bwd_p, fwd_b, bwd_b
    s[6], s[7], s[8], s[9] = ls["fwd_len_max"], ls["fwd_len_min"], ls["fwd_len_mean"], ls["fwd_len_std"]
    s[10], s[11], s[12], s[13] = ls["bwd_len_max"], ls["bwd_len_min"], ls["bwd_len_mean"], ls["bwd_len_std"]
    s[14] = per_s(b_all)
    s[15] = per_s(n_all)
    s[16], s[17], s[18], s[19] = it["iat_mean"], it["iat_std"], it["iat_max"], it["iat_min"]
    for base, d in ((20, "fwd"), (25, "bwd")):
        di = _dir_iat(flows, d)
        s[base], s[base + 1], s[base + 2], s[base + 3], s[base + 4] = (
            di["sum"], di["mean"], di["std"], di["max"], di["min"])
    s[30], s[31] = F.col("fwd_psh"), F.col("bwd_psh")
    s[32], s[33] = F.col("fwd_urg"), F.col("bwd_urg")
    s[36], s[37] = per_s(fwd_p), per_s(bwd_p)
    s[38], s[39] = F.col("len_min"), F.col("len_max")
    s[40] = b_all / n_all
    s[41] = F.col("len_std")
    s[42] = F.col("len_var")
    for i, name in enumerate(("fin", "syn", "rst", "psh", "ack", "urg")):
        s[43 + i] = F.col(f"fwd_{name}") + F.col(f"bwd_{name}")
    s[51] = F.when(fwd_p > 0, bwd_p / fwd_p).otherwise(0.0)
    s[52] = b_all / n_all
    s[53], s[54] = ls["fwd_len_mean"], ls["bwd_len_mean"]
    for i in range(56, 62):
        s[i] = F.lit(0.0)
    s[62], s[63], s[64], s[65] = fwd_p, fwd_b, bwd_p, bwd_b
    s[69] = F.lit(MIN_SEGMENT_SIZE)
    meta = {LAYOUT_KEY: LAYOUT_CICIDS}
    out = flows.select(*keep, *[c.cast("double").alias(f"f{i}", metadata=meta) for i, c in enumerate(s)])
    return out
