"""Anchored-timeout flow segmentation (the central operator).

Per flow key, rows in arrival order (``order_col``):

1. with no open flow, the row opens one and its timestamp is the anchor;
2. the row joins the open flow;
3. if ``ts - anchor > timeout`` (strictly) the flow closes, the row that
   triggered the close being its last row.

Flows still open at the end are not emitted unless ``emit_open``.  The
anchor is the first row of the flow, not the previous row, so neither
``session_window`` (gap based) nor ``window`` (fixed grid) expresses it.

Plan: hash-partition by key, sort by (key, order) inside partitions, then one
``mapInPandas`` sweep that carries only (key, seg_no, anchor, prev_ts) across
Arrow batches: O(1) memory per task whatever the size of a key.  Inside a
batch the sweep is vectorised: with non-decreasing timestamps the close row of
a flow is one ``searchsorted``, so the Python loop runs once per *flow*, not
per packet.  Each row leaves with ``seg_no``, ``start_us`` (anchor),
``iat_us`` (gap to the previous row of the same flow, NULL on the first) and
``closes`` (this row closed its flow); everything after this is native
``groupBy`` with map-side partial aggregation, so the second shuffle carries
one partial row per flow and partition rather than raw packets.
"""

from __future__ import annotations

from typing import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.scan import few, same
from flowlens.session import reliable_checkpoint

KEY5 = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def _null_aware_change(s: pd.Series) -> np.ndarray:
    """Boolean array: row i differs from row i-1 (NULL equals NULL)."""
    a = s.to_numpy()
    na = s.isna().to_numpy()
    out = np.ones(len(a), dtype=bool)
    if len(a) > 1:
        same = (a[1:] == a[:-1]) & ~na[1:] & ~na[:-1]
        same |= na[1:] & na[:-1]
        out[1:] = ~same
    return out


def closing_rows(ts: np.ndarray, t: int) -> np.ndarray:
    """For a flow anchored at each row: the first later row with a timestamp
    above the anchor's plus ``t`` (the row count when there is none)."""
    m = len(ts)
    limit = ts + t
    if m < 2 or bool(np.all(ts[1:] >= ts[:-1])):
        return np.searchsorted(ts, limit, side="right")
    # maxima of blocks of 2^k rows; skip blocks without a larger timestamp
    low = np.iinfo(np.int64).min
    maxima = [ts]
    while (1 << len(maxima)) <= m:
        last, half = maxima[-1], 1 << (len(maxima) - 1)
        maxima.append(np.maximum(last, np.r_[last[half:], np.full(half, low)]))
    at = np.arange(m)
    for k in range(len(maxima) - 1, -1, -1):
        inside = at < m
        skip = np.zeros(m, bool)
        skip[inside] = maxima[k][at[inside]] <= limit[inside]
        at = np.where(skip, np.minimum(at + (1 << k), m), at)
    return at


class _Sweep:
    """State carried across the Arrow batches of one partition."""

    def __init__(self, key: Sequence[str], ts_col: str, timeout_us: int, anchor_cols: Sequence[str],
                 entry_cols: Sequence[str] | None = None):
        self.key = list(key)
        self.ts_col = ts_col
        self.t = int(timeout_us)
        self.anchor_cols = list(anchor_cols)
        # optional (open, start, prev, next_seg, anchor values ...) columns giving
        # the state at the first row of each run (chunks of a split hot key)
        self.entry_cols = list(entry_cols) if entry_cols else None
        self.cur_key = None      # tuple of key values of the last row seen
        self.next_seg = 0        # seg_no the next opened flow gets
        self.open = False
        self.start = 0           # anchor ts of the open flow
        self.prev = 0            # ts of the last row of the open flow
        self.anchor_vals = None  # anchor_cols values of the open flow

    def run(self, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            yield self._batch(pdf)

    def _batch(self, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        change = np.zeros(n, dtype=bool)
        for c in self.key:
            change |= _null_aware_change(pdf[c])
        bounds = np.flatnonzero(change).tolist() + [n]
        ts_all = pdf[self.ts_col].to_numpy(dtype=np.int64)
        seg = np.empty(n, dtype=np.int64)
        start = np.empty(n, dtype=np.int64)
        iat = np.zeros(n, dtype=np.int64)
        iat_null = np.zeros(n, dtype=bool)
        closes = np.zeros(n, dtype=bool)
        anchors = {c: np.empty(n, dtype=object) for c in self.anchor_cols}
        anchor_src = {c: pdf[c].to_numpy(dtype=object) for c in self.anchor_cols}
        for i, b in enumerate(bounds[:-1]):
            e = bounds[i + 1]
            kv = tuple(None if pd.isna(pdf[c].iat[b]) else pdf[c].iat[b] for c in self.key)
            if i > 0 or kv != self.cur_key:
                self.cur_key, self.next_seg, self.open = kv, 0, False
                if self.entry_cols:
                    o, st, pv, sg, *av = (pdf[c].iat[b] for c in self.entry_cols)
                    self.open, self.next_seg = bool(o), int(sg)
                    if self.open:
                        self.start, self.prev = int(st), int(pv)
                        self.anchor_vals = dict(zip(self.anchor_cols, av))
            self._run(ts_all, b, e, seg, start, iat, iat_null, closes, anchors, anchor_src)
        out = pdf.assign(
            seg_no=seg,
            start_us=start,
            iat_us=pd.array(np.where(iat_null, 0, iat), dtype="Int64"),
            closes=closes,
        )
        out.loc[iat_null, "iat_us"] = pd.NA
        for c in self.anchor_cols:
            out["anchor_" + c] = anchors[c]
        return out

    def _fill(self, lo, hi, s, a, seg, start, anchors, av):
        seg[lo:hi] = s
        start[lo:hi] = a
        for c in self.anchor_cols:
            anchors[c][lo:hi] = av[c]

    def _run(self, ts_all, b, e, seg, start, iat, iat_null, closes, anchors, anchor_src):
        ts = ts_all[b:e]
        m = e - b
        # gaps inside the run; the first row's gap is to the carried prev row
        iat[b + 1:e] = np.diff(ts)
        iat[b] = ts[0] - self.prev if self.open else 0
        iat_null[b] = not self.open
        monotone = m < 2 or bool(np.all(ts[1:] >= ts[:-1]))
        closing = None if monotone else closing_rows(ts, self.t)
        carried = self.open
        pos = 0
        while pos < m:
            if not self.open:
                self.open, self.start = True, int(ts[pos])
                self.anchor_vals = {c: anchor_src[c][b + pos] for c in self.anchor_cols}
                iat_null[b + pos] = True
                if pos > 0:
                    iat[b + pos] = 0
            limit = self.start + self.t
            if monotone:
                c = int(np.searchsorted(ts, limit, side="right"))
                c = max(c, pos)
            elif carried:  # a flow of an earlier batch: its first row is not here
                over = ts > limit
                c = int(over.argmax()) if over.any() else m
            else:
                c = int(closing[pos])
            carried = False
            if c >= m:  # the flow stays open past this run
                self._fill(b + pos, e, self.next_seg, self.start, seg, start, anchors, self.anchor_vals)
                pos = m
            else:
                self._fill(b + pos, b + c + 1, self.next_seg, self.start, seg, start, anchors, self.anchor_vals)
                closes[b + c] = True
                self.next_seg += 1
                self.open = False
                pos = c + 1
        self.prev = int(ts[-1])


def segment_flows(
    packets: DataFrame,
    timeout_s: float,
    key: Sequence[str] = KEY5,
    order_col: str = "id",
    ts_col: str = "ts_us",
    anchor_cols: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Tag every packet with its flow (``seg_no`` within the key).

    Adds ``seg_no`` LONG, ``start_us`` LONG, ``iat_us`` LONG (NULL on a flow's
    first row), ``closes`` BOOLEAN and ``anchor_<c>`` for each ``anchor_cols``
    (value of ``c`` on the flow's first row).
    """
    key = list(key)
    timeout_us = int(round(timeout_s * 1_000_000))
    fields = list(packets.schema.fields) + [
        T.StructField("seg_no", T.LongType(), False),
        T.StructField("start_us", T.LongType(), False),
        T.StructField("iat_us", T.LongType(), True),
        T.StructField("closes", T.BooleanType(), False),
    ] + [T.StructField("anchor_" + c, packets.schema[c].dataType, True) for c in anchor_cols]
    out_schema = T.StructType(fields)
    anchor_cols = list(anchor_cols)

    def sweep(batches):
        yield from _Sweep(key, ts_col, timeout_us, anchor_cols).run(batches)

    # Without an explicit count the hash repartition is sized by AQE from the
    # shuffle statistics (coalesced to ~advisoryPartitionSizeInBytes); keys
    # never split, so the sweep stays exact either way.
    parts = packets.repartition(num_partitions, *key) if num_partitions else packets.repartition(*key)
    return parts.sortWithinPartitions(*key, order_col).mapInPandas(sweep, out_schema)


def closed_flow_rows(segmented: DataFrame, key: Sequence[str] = KEY5, emit_open: bool = False) -> DataFrame:
    """Keep rows of emitted flows: closed ones, plus open ones if ``emit_open``.

    A key numbers its flows from 0 and only its last one can be open, so the
    flows below the key's count of closing rows are the closed ones: one row
    per key, joined back (broadcast when its checked size allows).  The packet
    rows are not shuffled again, and no task gathers a flow.  The swept rows
    are written once, as both sides read them: select the columns you need
    before (the key, ``seg_no`` and ``closes`` among them).  Per-flow results
    do not need this: they aggregate first and filter on the aggregated flag."""
    if emit_open:
        return segmented
    rows = reliable_checkpoint(segmented)
    closed = rows.groupBy(*key).agg(F.count_if("closes").alias("_closed"))
    right, cond = same(rows, closed, key)
    return rows.join(few(right), [*cond, rows["seg_no"] < right["_closed"]], "left_semi")
