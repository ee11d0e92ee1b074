"""Running aggregates and as-of lookups along an order, at any group size.

A window over a whole group puts the group in one task.  Here rows are dealt
to range partitions of (group, order), so a group of any size spreads over as
many tasks as it needs, and a running value has two levels: inside the part of
a group that lies in one partition, and over the one summary row that each
such part leaves.  The second level has at most (groups + partitions) rows.

``ordered_parts`` deals the rows, ``running`` adds running values and ``as_of``
finds for each row the last row of another table that starts at or before it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import reliable_checkpoint

PART = "_part"
BROADCAST_ROWS = 200_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast when its counted rows allow."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``right`` with its key columns renamed, and the null-safe condition of
    a join on them."""
    names = [f"_r_{c}" for c in columns]
    right = right.withColumnsRenamed(dict(zip(columns, names)))
    return right, [left[c].eqNullSafe(right[n]) for c, n in zip(columns, names)]


def ordered_parts(df: DataFrame, group: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows in range partitions of (group, order), whose number is in
    ``PART``; written to the shared folder, so that it does not change."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable_checkpoint(df.repartitionByRange(n, *group, *order).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str],
            values: dict[str, tuple[str, str]], own: bool = False) -> DataFrame:
    """``rows`` (of :func:`ordered_parts`) with a running value per name in
    ``values``: the ``max``, ``sum`` or ``last`` (not null) of a column over
    the rows of the group that come earlier, with ``own`` also the row itself.
    ``order`` must order a group's rows totally."""
    group, order = list(group), list(order)
    inside = Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if own else -1)
    between = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    over = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}

    def whole(kind, column):  # the value of a whole part
        if kind != "last":
            return over[kind](column)
        return F.max(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_v"))))["_v"]
    parts = rows.groupBy(*group, PART).agg(*[whole(k, c).alias(f"_p_{n}") for n, (k, c) in values.items()])
    carried = reliable_checkpoint(parts.select(
        *group, PART, *[over[k](f"_p_{n}").over(between).alias(f"_c_{n}") for n, (k, _) in values.items()]))
    local = rows.withColumns({f"_l_{n}": over[k](c).over(inside) for n, (k, c) in values.items()})
    right, cond = same(local, carried, [*group, PART])
    out = local.join(few(right), cond, "left")

    def both(n, kind):
        here, there = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "max":
            return F.greatest(here, there)
        if kind == "last":
            return F.coalesce(here, there)
        return F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
    return out.withColumns({n: both(n, k) for n, (k, _) in values.items()}) \
        .select(*rows.columns, *values)


def as_of(left: DataFrame, right: DataFrame, group: Sequence[str], at: str, start: str,
          found: str = "found") -> DataFrame:
    """``left`` with the last row of ``right`` of the same group (nulls are
    equal) whose ``start`` is at or before ``at``, as the struct ``found`` of
    ``right``'s other columns and ``start`` (null when there is none).  Of rows
    of ``right`` with equal group and start any one is taken."""
    group = list(group)
    value = F.struct(*[c for c in right.columns if c not in group])
    events = right.select(*group, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
                          value.alias("_value"), F.lit(None).cast(left.schema).alias("_row"))
    tie = F.xxhash64(*left.columns)
    events = events.unionByName(left.select(
        *group, F.col(at).alias("_at"), F.lit(1).alias("_kind"), tie.alias("_tie"),
        F.lit(None).cast(events.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_row")))
    order = ["_at", "_kind", "_tie"]
    parts = ordered_parts(events, group, order)
    return running(parts, group, order, {found: ("last", "_value")}, own=True) \
        .where("_kind = 1").select("_row.*", found)
