"""Structured Streaming flow assembly (anchored timeout, per-key state).

``groupBy(key).transformWithStateInPandas`` over the RocksDB state store.  A
key has a value state ``flow`` only while one of its flows is open: O(1)
running statistics (counts, sums, Welford mean/M2, min, max, flag counts,
label of the last row), never the packet list.  So the state is bounded by the
open flows.  A flow closes when a packet arrives more than ``timeout`` after
the flow's first packet; that packet belongs to the closed flow, which is
emitted as one aggregate row with the same columns as the batch
``flow_aggregates``, so the same feature projection serves batch and stream.
Where flows are to be numbered over a key's whole life, a second value state
keeps the next number (one long per key ever seen).

Idle flows: with ``idle_timeout_s`` a flow ends when its key is silent for
longer than that in event time: either the next packet tells, or a timer that
fires once the watermark has passed the flow's last packet plus that time.
``emit_idle=True`` emits it then, marked ``closed = false``.  Both ways give
the same flows, wherever micro-batches are cut.  Without it, a flow that never
sees a closing packet is never emitted, as in the batch rule.

Within one micro-batch a key's rows are put back in arrival (id) order and
processed like the batch sweep: closing rows come from one table and the
statistics of a flow's slice are numpy reductions merged into the carried
state, so Python runs once per flow, not per packet.  Of a key's packets in a
micro-batch a few numbers each are held together; ``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` bounds them.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.functions.packets import FLAG_MASKS, FLAG_NAMES
from flowlens.operators.segment import KEY5, closing_rows

FLOW_STATE = (
    "start_us long, prev_us long, first_id long, last_id long, "
    "n long, fwd_n long, fwd_sum long, fwd_mean double, fwd_m2 double, fwd_min int, fwd_max int, "
    "iat_n long, iat_sum long, iat_mean double, iat_m2 double, iat_min long, iat_max long, "
    + ", ".join(f"f_{n.lower()} long" for n in FLAG_NAMES) + ", label string, timer long"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that value states and timers need; changes only are
    written at each micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def output_schema(key_schema: str) -> str:
    return (key_schema + ", seg_no long, n_pkts long, fwd_pkts long, bwd_pkts long, fwd_bytes long, "
            "bwd_bytes long, fwd_len_min int, fwd_len_max int, fwd_len_std double, "
            "bwd_len_min int, bwd_len_max int, bwd_len_std double, start_us long, end_us long, "
            "iat_n long, iat_sum long, iat_min long, iat_max long, iat_std double, closed boolean, "
            "first_id long, close_id long, "
            + ", ".join(f"fwd_{n.lower()} long, bwd_{n.lower()} long" for n in FLAG_NAMES)
            + ", label string")


def _merge(n_a: int, mean_a: float, m2_a: float, x: np.ndarray):
    """Combine running (n, mean, M2) with a batch of values."""
    n_b = len(x)
    if n_b == 0:
        return n_a, mean_a, m2_a
    xf = x.astype(np.float64)
    mean_b = float(xf.mean())
    m2_b = float(((xf - mean_b) ** 2).sum())
    n = n_a + n_b
    delta = mean_b - mean_a
    return n, mean_a + delta * n_b / n, m2_a + m2_b + delta * delta * n_a * n_b / n


def _fold(fn, cur, v):
    return v if cur is None else fn(cur, v)


class _Flow:
    """Running stats of one open flow (all packets forward: directed key)."""

    __slots__ = ("open", "start", "prev", "first_id", "last_id", "n", "fwd_n", "fwd_sum",
                 "fwd_mean", "fwd_m2", "fwd_min", "fwd_max", "iat_n", "iat_sum", "iat_mean", "iat_m2",
                 "iat_min", "iat_max", "flags", "label")

    def __init__(self):
        self.open = False
        self.reset()

    def reset(self):
        self.start = self.prev = self.first_id = self.last_id = 0
        self.n = self.fwd_n = self.fwd_sum = self.iat_n = self.iat_sum = 0
        self.fwd_mean = self.fwd_m2 = self.iat_mean = self.iat_m2 = 0.0
        self.fwd_min = self.fwd_max = self.iat_min = self.iat_max = None
        self.flags = [0] * len(FLAG_NAMES)
        self.label = None

    @classmethod
    def from_state(cls, t):
        f = cls()
        f.open = True
        (f.start, f.prev, f.first_id, f.last_id, f.n, f.fwd_n, f.fwd_sum, f.fwd_mean,
         f.fwd_m2, f.fwd_min, f.fwd_max, f.iat_n, f.iat_sum, f.iat_mean, f.iat_m2, f.iat_min,
         f.iat_max) = t[:17]
        f.flags = list(t[17:17 + len(FLAG_NAMES)])
        f.label = t[17 + len(FLAG_NAMES)]
        return f

    def to_state(self, timer):
        return (self.start, self.prev, self.first_id, self.last_id, self.n,
                self.fwd_n, self.fwd_sum, self.fwd_mean, self.fwd_m2, self.fwd_min, self.fwd_max,
                self.iat_n, self.iat_sum, self.iat_mean, self.iat_m2, self.iat_min, self.iat_max,
                *self.flags, self.label, timer)

    def add_slice(self, ids, ts, ln, fl, pr, labels, lo, hi):
        """Add rows [lo, hi) of one key's id-ordered arrays in one step:
        numpy sums/min/max per slice and a parallel (Chan) merge of the
        Welford mean/M2, so Python runs once per flow slice, not per row."""
        if not self.open:
            self.reset()
            self.open, self.start, self.first_id = True, int(ts[lo]), int(ids[lo])
            gaps = np.diff(ts[lo:hi])
        else:
            gaps = np.diff(ts[lo:hi], prepend=self.prev)
        seg_ln = ln[lo:hi]
        self.n += hi - lo
        self.fwd_n, self.fwd_mean, self.fwd_m2 = _merge(self.fwd_n, self.fwd_mean, self.fwd_m2, seg_ln)
        self.fwd_sum += int(seg_ln.sum())
        self.fwd_min = _fold(min, self.fwd_min, int(seg_ln.min()))
        self.fwd_max = _fold(max, self.fwd_max, int(seg_ln.max()))
        if len(gaps):
            self.iat_n, self.iat_mean, self.iat_m2 = _merge(self.iat_n, self.iat_mean, self.iat_m2, gaps)
            self.iat_sum += int(gaps.sum())
            self.iat_min = _fold(min, self.iat_min, int(gaps.min()))
            self.iat_max = _fold(max, self.iat_max, int(gaps.max()))
        tcp = pr[lo:hi] == 6
        if tcp.any():
            f = fl[lo:hi][tcp]
            for i, name in enumerate(FLAG_NAMES):
                self.flags[i] += int(np.count_nonzero(f & FLAG_MASKS[name]))
        self.prev, self.last_id, self.label = int(ts[hi - 1]), int(ids[hi - 1]), labels[hi - 1]

    def emit(self, key, seg_no: int, closed: bool):
        std = lambda m2, n: math.sqrt(m2 / n) if n else None
        row = [*key, seg_no, self.n, self.fwd_n, 0, self.fwd_sum, 0, self.fwd_min, self.fwd_max,
               std(self.fwd_m2, self.fwd_n), None, None, None, self.start, self.prev,
               self.iat_n, self.iat_sum if self.iat_n else None, self.iat_min, self.iat_max,
               std(self.iat_m2, self.iat_n), closed, self.first_id, self.last_id]
        for c in self.flags:
            row += [c, 0]
        row.append(self.label)
        return row


_PANDAS = {"bigint": "Int64", "int": "Int32", "double": "float64", "boolean": "bool"}


class FlowProcessor(StatefulProcessor):
    """Assembles the flows of one key.  ``numbered``: flows are numbered over
    the key's whole life, else from 0 in each run of its state."""

    def __init__(self, timeout_us: int, schema: T.StructType, idle_us: int | None, emit_idle: bool, numbered: bool):
        self.timeout_us, self.idle_us, self.emit_idle, self.numbered = timeout_us, idle_us, emit_idle, numbered
        self.columns = [(f.name, _PANDAS.get(f.dataType.simpleString(), "object")) for f in schema]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW_STATE)
        if self.numbered:
            self.number = handle.getValueState("number", "next long")

    def _frames(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            values = list(zip(*rows))
            yield pd.DataFrame({name: pd.Series(v, dtype=kind) for (name, kind), v in zip(self.columns, values)})

    def _keep(self, f: _Flow, timer) -> None:
        """Write the state back, with the timer of an open flow."""
        due = int(f.prev // 1000 + self.idle_us // 1000 + 1) if f.open and self.idle_us is not None else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if f.open:
            self.flow.update(f.to_state(due))
        elif self.flow.exists():
            self.flow.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.flow.get() if self.flow.exists() else None
        f, timer = (_Flow.from_state(state), state[-1]) if state is not None else (_Flow(), None)
        next_seg = self.number.get()[0] if self.numbered and self.number.exists() else 0
        parts = [(p["id"].to_numpy(np.int64), p["ts_us"].to_numpy(np.int64), p["length"].fillna(0).to_numpy(np.int64),
                  p["tcp_flags"].fillna(0).to_numpy(np.int64), p["protocol"].fillna(-1).to_numpy(np.int64),
                  p["label"].to_numpy(object) if "label" in p else np.full(len(p), None, dtype=object)) for p in rows]
        order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        ids, ts, ln, fl, pr, lab = (np.concatenate(c)[order] for c in zip(*parts))
        m, seg, out = len(ts), next_seg, []
        closing = closing_rows(ts, self.timeout_us)
        silent = np.zeros(0, np.int64)          # rows that come after a silence
        if self.idle_us is not None:
            silent = np.flatnonzero(np.diff(ts, prepend=f.prev if f.open else ts[0]) > self.idle_us)
        pos = 0
        while pos < m:
            if f.open:  # a flow of an earlier micro-batch
                over = ts > f.start + self.timeout_us
                c, after = int(over.argmax()) if over.any() else m, 0
            else:
                c, after = int(closing[pos]), pos + 1
            at = int(np.searchsorted(silent, after))
            gap = int(silent[at]) if at < len(silent) else m
            end = gap if gap <= c else min(c + 1, m)
            if end > pos:
                f.add_slice(ids, ts, ln, fl, pr, lab, pos, end)
            if gap <= c and gap < m:             # it ended in silence before row ``gap``
                if self.emit_idle:
                    out.append(f.emit(key, seg, False))
                f.open, seg = False, seg + 1
            elif c < m:                          # row c closed it
                out.append(f.emit(key, seg, True))
                f.open, seg = False, seg + 1
            pos = end
        self._keep(f, timer)
        if self.numbered and seg != next_seg:
            self.number.update((seg,))
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.flow.exists():
            f = _Flow.from_state(self.flow.get())
            seg = self.number.get()[0] if self.numbered and self.number.exists() else 0
            if self.emit_idle:
                out.append(f.emit(key, seg, False))
            self.flow.clear()
            if self.numbered:
                self.number.update((seg + 1,))
        yield from self._frames(out)

    def close(self) -> None:
        pass


def assemble_flows(packets: DataFrame, timeout_s: float, key: Sequence[str] = KEY5,
                   idle_timeout_s: float | None = None, emit_idle: bool = False,
                   watermark: str = "1 hour", drop_closed: bool = False) -> DataFrame:
    """ST1-ST3: streaming packets -> one aggregate row per flow.

    ``drop_closed`` keeps nothing of a key whose flow has closed: ``seg_no``
    begins anew (``first_id`` and ``close_id`` stay unique)."""
    use_rocksdb(packets.sparkSession)
    key = list(key)
    key_schema = ", ".join(f"{c} {packets.schema[c].dataType.simpleString()}" for c in key)
    schema = T.StructType.fromDDL(output_schema(key_schema))
    idle_us = int(idle_timeout_s * 1_000_000) if idle_timeout_s is not None else None
    df = packets
    if idle_us is not None:
        df = df.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)
    cols = [*key, "id", "ts_us", "length", "tcp_flags", "protocol"] + (["label"] if "label" in df.columns else [])
    cols = list(dict.fromkeys(cols + (["event_time"] if idle_us is not None else [])))
    processor = FlowProcessor(int(round(timeout_s * 1_000_000)), schema, idle_us, emit_idle, not drop_closed)
    return df.select(*cols).groupBy(*key).transformWithStateInPandas(
        processor, schema, "append", "EventTime" if idle_us is not None else "None")
