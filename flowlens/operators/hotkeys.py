"""Exact anchored-timeout segmentation with hot keys split across tasks.

The sequential rule (a flow starts at the row after the previous flow's
close) makes a key's sweep a chain.  For keys that hold many packets the
chain is cut into chunks of at most ``CHUNK_ROWS`` rows (range partitions by
key and id, cut by row numbers, so chunks follow row counts, not id widths, and
the number of tasks does not follow that of the chunks) and solved by Spark
jobs:

1. Per chunk (parallel): its exit state as a function of its entry state.  An
   open flow anchored at A closes at the first row with ts > A + T, which is
   the first *record* (running maximum) above it; A is at most the largest
   earlier timestamp of the key, so only the records up to that plus T matter.
   For each of them, and for "no open flow", the exit state comes from pointer
   doubling over the chunk's next-anchor links.  Timestamps need not rise.
   The function is a table of rows ``lo <= limit < hi -> exit``.
2. A tree of such functions.  Two neighbouring groups of chunks compose: each
   exit of the left one that leaves a flow open is looked up in the right one
   (an as-of lookup over range partitions, ``operators.scan``, so no task holds
   a group's table), and the right one's records above the left one's largest
   timestamp join behind.  What no entry can reach within T is left out.
   log2(chunks) levels later every key has one function.
3. Back down the tree: a group's left half starts in the group's entry state,
   its right half where the left half's function leads.  One row per group.
4. Per chunk (parallel): the ordinary sweep, started from its entry state.

The result equals the sequential sweep row for row.  Keys below
``HOT_KEY_ROWS`` take the plain sweep, which has O(1) state.  No step runs
through a key's chunks one after the other, and no task reads more of a key
than a range partition or one chunk.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.scan import as_of, few
from flowlens.operators.segment import KEY5, _Sweep, closing_rows, segment_flows
from flowlens.session import reliable_checkpoint

HOT_KEY_ROWS = 2_000_000
CHUNK_ROWS = 500_000
PART_ROWS = 500_000   # rows of a range partition, which holds one or more chunks
_LOW = -2 ** 62   # below every limit


def exits(ts: np.ndarray, t: int):
    """For a fresh flow starting at each row: the row whose flow is still open
    at the chunk's end (the row count: none) and the flows closed on the way."""
    m = len(ts)
    c = closing_rows(ts, t)
    succ = np.empty(m + 1, np.int64)
    add = np.zeros(m + 1, np.int64)
    stays_open = c >= m
    succ[:m] = np.where(stays_open, np.arange(m), np.minimum(c + 1, m))
    add[:m] = ~stays_open
    succ[m] = m
    for _ in range(int(np.ceil(np.log2(m + 2))) + 1):
        add, succ = add + add[succ], succ[succ]
    return succ, add


#: A transition: an entry state and the exit state it leads to.  Entry: a flow
#: open with lo <= limit < hi (closed by the record ``hi``), or none open
#: (lo and hi are null).  Exit: the flow that is left open (anchor time and
#: id) or none, and the flows closed on the way.
_EXIT = ["is_open", "anchor", "anchor_id", "closes"]
TRANSITIONS = "_k long, g long, lo long, hi long, is_open boolean, anchor long, anchor_id long, closes long"


def _chunk_transitions(t: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ts, ids = pdf["ts_us"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
        m = len(ts)
        succ, add = exits(ts, t)
        top = np.maximum.accumulate(ts)
        record = np.flatnonzero(np.r_[True, top[1:] > top[:-1]])
        before = pdf["_before"].iat[0]
        if not pd.isna(before):  # one record above the largest possible limit is enough
            record = record[:int(np.searchsorted(ts[record], int(before) + t, side="right")) + 1]
        else:
            record = record[:0]  # the key's first chunk: no flow is open yet
        start = np.r_[0, record + 1]             # where the next flow starts: none open, or after each record
        end = succ[start]
        opened = end < m
        at = np.minimum(end, m - 1)
        closed = add[start] + np.r_[0, np.ones(len(record), np.int64)]
        hi = pd.array(np.r_[0, ts[record]], dtype="Int64")
        lo = pd.array(np.r_[0, _LOW, ts[record][:-1]][:len(hi)], dtype="Int64")
        hi[0] = lo[0] = pd.NA
        return pd.DataFrame({"_k": pdf["_k"].iat[0], "g": pdf["_g"].iat[0], "lo": lo, "hi": hi, "is_open": opened,
                             "anchor": np.where(opened, ts[at], 0), "anchor_id": np.where(opened, ids[at], 0),
                             "closes": closed})
    return fn


def _composed(table: DataFrame, groups: DataFrame, t: int) -> DataFrame:
    """The transitions of pairs of groups (2g, 2g + 1), as those of group g;
    ``groups``: per pair, ``top`` of its left half and ``before`` of the pair."""
    sided = table.withColumn("_right", F.col("g") % 2 == 1).withColumn("g", F.shiftright("g", 1))
    left, right = sided.where("NOT _right").drop("_right"), sided.where("_right").drop("_right")
    idle = right.where("hi IS NULL").select("_k", "g", F.struct(*_EXIT).alias("then"))
    steps = right.where("hi IS NOT NULL")
    entry = ["_k", "g", "lo", "hi"]
    # a flow left open meets the right half's records; none open, its first row
    found = as_of(left.where("is_open").withColumn("_limit", F.col("anchor") + t),
                  steps.select("_k", "g", "lo", "hi", *_EXIT), ["_k", "g"], "_limit", "lo", "then") \
        .withColumn("then", F.when(F.col("_limit") < F.col("then.hi"), F.struct(*[F.col(f"then.{c}").alias(c) for c in _EXIT])))
    met = found.drop("_limit").unionByName(left.where("NOT is_open").join(few(idle), ["_k", "g"], "left"))
    now = [F.when(F.col("then").isNull(), F.col(c)).otherwise(F.col(f"then.{c}")).alias(c) for c in _EXIT[:-1]]
    met = met.select(*entry, *now, (F.col("closes") + F.coalesce("then.closes", F.lit(0))).alias("closes"))
    # limits above the left half's timestamps pass through it
    beyond = steps.join(few(groups), ["_k", "g"]).withColumn("lo", F.greatest("lo", "top")) \
        .where((F.col("hi") > F.col("lo")) & (F.col("lo") <= F.col("before") + t))
    return met.unionByName(beyond.select(*entry, *_EXIT))


def _entries(table: DataFrame, chunks: DataFrame, t: int, parts: int) -> DataFrame:
    """``_k, g, e_open, e_start, e_id, e_seg``: the state in which each chunk
    is entered.  ``chunks``: ``_k, g, top, before`` of every chunk.  A level is
    a union of parts of the last one: without a bound its partitions would
    double at every level; it is written in at most ``parts``."""
    last = chunks.agg(F.max("g")).first()[0] or 0
    levels = [table]
    for level in range(int(last).bit_length()):
        half = F.shiftright("g", level)
        halves = chunks.groupBy("_k", half.alias("h")).agg(F.max("top").alias("top"), F.min_by("before", "g").alias("before"))
        groups = halves.where("h % 2 = 0").select("_k", F.shiftright("h", 1).alias("g"), "top", "before")
        levels.append(reliable_checkpoint(_composed(levels[-1], groups, t).coalesce(parts)))
    none = [F.lit(False).alias("e_open"), *[F.lit(0).cast("long").alias(c) for c in ("e_start", "e_id", "e_seg")]]
    entries = chunks.select("_k").distinct().select("_k", F.lit(0).cast("long").alias("g"), *none)
    for level in range(len(levels) - 2, -1, -1):
        there = chunks.select("_k", F.shiftright("g", level).alias("g")).distinct()
        left = levels[level].where("g % 2 = 0").withColumn("g", F.shiftright("g", 1))
        limit = F.col("e_start") + t
        reached = F.when(F.col("e_open"), (F.col("lo") <= limit) & (limit < F.col("hi"))).otherwise(F.col("hi").isNull())
        hits = left.join(few(entries), ["_k", "g"]).where(reached).select("_k", "g", F.struct(*_EXIT).alias("then"))
        state = entries.join(hits, ["_k", "g"], "left")
        passed = F.col("then").isNull()          # the open flow passes through the left half
        second = state.select(
            "_k", (2 * F.col("g") + 1).alias("g"),
            *[F.when(passed, F.col(e)).otherwise(F.col(f"then.{c}")).alias(e)
              for e, c in (("e_open", "is_open"), ("e_start", "anchor"), ("e_id", "anchor_id"))],
            (F.col("e_seg") + F.coalesce("then.closes", F.lit(0))).alias("e_seg"))
        first = entries.withColumn("g", 2 * F.col("g"))
        entries = reliable_checkpoint(first.unionByName(second).join(there, ["_k", "g"], "left_semi").coalesce(parts))
    return entries


def key_counts(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("_hn"))


def segment_flows_split(packets: DataFrame, timeout_s: float, key: Sequence[str] = KEY5,
                        hot_key_rows: int | None = None, chunk_rows: int | None = None,
                        anchor_cols: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Same output as :func:`segment_flows` (order column ``id``, time
    ``ts_us``), with keys of at least ``hot_key_rows`` rows segmented in
    parallel chunks.  ``counts``: the rows of each key (``_hn``), where they
    are known already."""
    key, anchor_cols = list(key), list(anchor_cols)
    hot_key_rows, chunk_rows = hot_key_rows or HOT_KEY_ROWS, chunk_rows or CHUNK_ROWS
    t = int(round(timeout_s * 1_000_000))
    # at most N / hot_key_rows rows: materialised once, so an input without
    # hot keys keeps the plain one-sweep plan
    hot = reliable_checkpoint((key_counts(packets, key) if counts is None else counts)
                              .where(F.col("_hn") >= hot_key_rows).withColumn("_k", F.monotonically_increasing_id()))
    n_hot = hot.agg(F.sum("_hn")).first()[0]
    if not n_hot:
        return segment_flows(packets, timeout_s, key=key, anchor_cols=anchor_cols)
    names = [f"_hk{i}" for i in range(len(key))]
    hot = few(hot.select(*[F.col(c).alias(n) for c, n in zip(key, names)], "_k"))
    cond = [packets[c].eqNullSafe(hot[n]) for c, n in zip(key, names)]
    plain = packets.join(hot, cond, "left_anti")
    usual = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = int(max(min(-(-n_hot // chunk_rows), usual), -(-n_hot // max(chunk_rows, PART_ROWS))))
    part = 1 << 33   # monotonically_increasing_id: the partition's number times this, and the row's number in it
    rows = reliable_checkpoint(packets.join(hot, cond).drop(*names).repartitionByRange(parts, "_k", "id")
                               .sortWithinPartitions("_k", "id").withColumn("_row", F.monotonically_increasing_id())
                               .withColumn("_chunk", F.expr(f"_row - _row % {part} + _row % {part} DIV {chunk_rows}")).drop("_row"))

    order = Window.partitionBy("_k").orderBy("_chunk")   # a key's chunks, one row each
    chunks = reliable_checkpoint(
        rows.groupBy("_k", "_chunk").agg(F.max("ts_us").alias("top"), F.max_by("ts_us", "id").alias("last_ts"))
        .select("_k", "_chunk", "top", (F.row_number().over(order) - 1).cast("long").alias("g"),
                F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                F.coalesce(F.lag("last_ts").over(order), F.lit(0).cast("long")).alias("e_prev")))
    small = few(chunks.select("_k", "_chunk", F.col("g").alias("_g"), F.col("before").alias("_before")))
    table = reliable_checkpoint(rows.select("_k", "_chunk", "id", "ts_us").join(small, ["_k", "_chunk"])
                                .groupBy("_k", "_chunk").applyInPandas(_chunk_transitions(t), TRANSITIONS))
    entries = _entries(table, chunks.select("_k", "g", "top", "before"), t, max(usual, parts))
    entries = entries.join(chunks.select("_k", "g", "_chunk", "e_prev"), ["_k", "g"]).drop("g")
    if anchor_cols:  # the values of the rows at which the entry flows began
        began = rows.join(few(entries.select("_k", F.col("e_id").alias("id")).distinct()), ["_k", "id"]) \
            .select("_k", F.col("id").alias("e_id"), *[F.col(c).alias(f"e_anchor_{c}") for c in anchor_cols])
        entries = entries.join(began, ["_k", "e_id"], "left")
    state = ["e_open", "e_start", "e_prev", "e_seg", *[f"e_anchor_{c}" for c in anchor_cols]]
    entries = few(reliable_checkpoint(entries.select("_k", "_chunk", *state)))
    sweep_in = rows.join(entries, ["_k", "_chunk"]).select(*packets.columns, "_k", "_chunk", *state)
    out_schema = T.StructType(list(sweep_in.schema.fields) + [
        T.StructField("seg_no", T.LongType(), False), T.StructField("start_us", T.LongType(), False),
        T.StructField("iat_us", T.LongType(), True), T.StructField("closes", T.BooleanType(), False)]
        + [T.StructField("anchor_" + c, packets.schema[c].dataType, True) for c in anchor_cols])

    def sweep(batches):
        yield from _Sweep(["_k", "_chunk"], "ts_us", t, anchor_cols, entry_cols=state).run(batches)

    swept = sweep_in.repartition("_k", "_chunk").sortWithinPartitions("_k", "_chunk", "id") \
        .mapInPandas(sweep, out_schema).drop("_k", "_chunk", *state)
    return segment_flows(plain, timeout_s, key=key, anchor_cols=anchor_cols).unionByName(swept)
