"""Exact sampling, splitting and top-k by distributed selection.

An exact cut finds one threshold and then filters; no rows are sorted,
shuffled or ranked.

* ``nth`` (T3, W4) finds the n-th value of ordering columns.  A mergeable
  quantile sketch gives a grid of values of whatever is still in question; the
  two that enclose the n-th are counted exactly, and only what lies strictly
  between them stays in question.  The sketch works on ranks, so far outliers
  and clusters of ids make no difference.  A round leaves a few thousandths of
  the rows, so from the second round on the scan is a narrow pushed-down filter.
* ``hash_cut`` (T5, T6) cuts each class by a seeded hash.  The hash is uniform,
  so the cut of a class of N rows lies within a few sqrt(N) ranks of where its
  share says; one aggregate counts the rows below that bracket and lists those
  inside.  Should the exact cut lie outside after all, the bracket grows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import few, same
from flowlens.session import reliable_checkpoint

#: Grid of the quantile sketch, and its accuracy (ranks are right to N / ACCURACY).
GRID, ACCURACY = 1000, 10_000
#: Rows in question that are ordered directly.
DIRECT = 50_000
#: Bits of the hash that the bracket of a class is taken from.
HASH_HEX = 15
#: Half the width of a bracket, in standard deviations of the cut's rank.
SPREAD = 6.0


def seeded_hash(id_col: str, seed: int) -> Column:
    """md5 of ``id|seed`` as hex text: a seeded, engine-independent order."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def _leading(h: Column) -> Column:
    """The first hex digits of a hash as a number, in hash order."""
    return F.conv(F.substring(h, 1, HASH_HEX), 16, 10).cast("long")


def nth(df: DataFrame, order: Sequence[str], n: int, direct: int = DIRECT, grid: int = GRID) -> tuple | None:
    """The ``n``-th (from 1) smallest tuple of the numeric, non-null columns
    ``order``; None where there are fewer rows."""
    scope, known, need = df.select(*order), [], n
    for column in order:
        c = F.col(column)
        while True:
            if need < 1:
                return None
            sketch = scope.agg(F.count(F.lit(1)).alias("n"),
                               F.percentile_approx(c, [i / grid for i in range(grid + 1)], ACCURACY).alias("q")).first()
            total = sketch["n"]
            if need > total:
                return None
            if total <= direct:  # a measured, small rest
                row = scope.orderBy(*order).offset(need - 1).limit(1).first()
                return tuple(row)
            q, slack = sketch["q"], 1 + grid // ACCURACY + 1
            at = need * grid / total
            lo, hi = q[max(0, int(at) - slack)], q[min(grid, int(at) + 1 + slack)]
            count = scope.agg(*[F.count_if(x).alias(k) for k, x in
                                (("a", c < lo), ("b", c <= lo), ("c", c < hi), ("d", c <= hi))]).first()
            if need <= count["a"]:
                scope = scope.where(c < lo)
            elif need <= count["b"]:
                scope, need, value = scope.where(c == lo), need - count["a"], lo
                break
            elif need <= count["c"]:
                scope, need = scope.where((c > lo) & (c < hi)), need - count["b"]
            elif need <= count["d"]:
                scope, need, value = scope.where(c == hi), need - count["c"], hi
                break
            else:
                scope, need = scope.where(c > hi), need - count["d"]
        known.append(value)
    return tuple(known)


def _upto(order: Sequence[str], limit: tuple) -> Column:
    """Rows whose ``order`` is at or before ``limit``."""
    out = F.lit(True)
    for c, v in reversed(list(zip(order, limit))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def hash_cut(df: DataFrame, id_col: str, seed: int, quota, class_col: str | None = None,
             spread: float = SPREAD) -> DataFrame:
    """``df`` with ``_in``: whether a row is among the first ``n`` of its class
    in the order of the seeded hash of its id (then of the id).  ``quota`` is n;
    with ``class_col``, a function from the (class, ``_n_rows``) table to the
    (class, n) table.  Ids are unique inside a class."""
    cls = [class_col] if class_col else []
    hashed = df.withColumn("_h", seeded_hash(id_col, seed))
    if cls:
        sizes = reliable_checkpoint(df.groupBy(*cls).agg(F.count(F.lit(1)).alias("_n_rows")))
        right, cond = same(sizes, quota(sizes), cls)
        sizes = sizes.join(right, cond).select(*cls, "_n_rows", F.col("n").cast("long").alias("_n"))
    else:
        sizes = df.agg(F.count(F.lit(1)).alias("_n_rows")).withColumn("_n", F.lit(int(quota)).cast("long"))
    share, top = F.col("_n") / F.greatest(F.col("_n_rows"), F.lit(1)), float(16 ** HASH_HEX)
    part = [F.col("_n") >= F.col("_n_rows"), F.col("_n") <= 0]
    while True:
        half = spread * F.sqrt(share * (1 - share) / F.col("_n_rows")) + spread * spread / F.col("_n_rows")
        plan = few(reliable_checkpoint(sizes.withColumns({
            "_lo": F.when(part[0] | part[1], None).otherwise((F.greatest(share - half, F.lit(0.0)) * top).cast("long")),
            "_hi": F.when(part[0] | part[1], None).otherwise((F.least(share + half, F.lit(1.0)) * top).cast("long"))})))
        rows = hashed.withColumn("_lead", _leading(F.col("_h")))
        if cls:
            right, cond = same(rows, plan, cls)
            rows = rows.join(right, cond).drop(*[f"_r_{c}" for c in cls])
        else:
            one = plan.first()
            rows = rows.withColumns({c: F.lit(one[c]).cast("long") for c in ("_n", "_n_rows", "_lo", "_hi")})
        # one pass: rows below the bracket collapse to a count, those inside stay
        inside = F.col("_lead") >= F.col("_lo")
        near = rows.where(F.col("_lead") <= F.col("_hi")).groupBy(
            *cls, "_n", F.when(inside, F.col("_h")).alias("_th"), F.when(inside, F.col(id_col)).alias("_tid")) \
            .agg(F.count(F.lit(1)).alias("_c"))
        # a class has O(sqrt(N)) rows here
        w = Window.partitionBy(*cls).orderBy(F.col("_th").asc_nulls_first(), "_tid") \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = reliable_checkpoint(near.withColumn("_cum", F.sum("_c").over(w))
                                    .where("_th IS NOT NULL AND _cum = _n").select(*cls, "_th", "_tid"))
        if found.count() == sizes.where("_n > 0 AND _n < _n_rows").count():
            break
        spread *= 4
    whole = sizes.where("_n >= _n_rows").select(*cls, F.lit("~").alias("_th"))   # above every hex digit
    found = found.unionByName(whole, allowMissingColumns=True)
    if cls:
        right, cond = same(hashed, found, cls)
        out = hashed.join(few(right), cond, "left").drop(*[f"_r_{c}" for c in cls])
    else:
        one = found.first()
        out = hashed.withColumns({c: F.lit(one[c] if one else None).cast(found.schema[c].dataType) for c in ("_th", "_tid")})
    taken = (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(id_col) <= F.col("_tid")))
    return out.withColumn("_in", F.coalesce(taken, F.lit(False))).drop("_h", "_th", "_tid")


def sample_exact_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """T5: exactly ``n`` rows without replacement (all rows if fewer exist)."""
    return hash_cut(df, id_col, seed, n).where("_in").drop("_in")


def stratified_quota(df: DataFrame, class_col: str, test_size: float = 0.2,
                     count_col: str | None = None) -> DataFrame:
    """Per-class test quota: n_test = ceil(test_size * N); floor of each
    class's share, then the leftover rows by largest remainder, ties to the
    smaller class label.  Works on the (small) class-count table; ``df`` may
    be the rows or an already counted table (``count_col``)."""
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = df.groupBy(class_col).agg(n.alias("_c"))
    total = counts.agg(F.sum("_c")).first()[0] or 0  # one number
    q = counts.withColumn("_N", F.lit(total).cast("long")).withColumn(
        "_nt", F.ceil(F.lit(float(test_size)) * F.col("_N")).cast("long"))
    q = q.withColumns({"_base": F.floor(F.col("_nt") * F.col("_c") / F.col("_N")).cast("long"),
                       "_rem": (F.col("_nt") * F.col("_c")) % F.col("_N")})
    # the class-count table holds one row per class: a global window is fine
    w_all = Window.partitionBy(F.lit(0))
    q = q.withColumn("_left", F.col("_nt") - F.sum("_base").over(w_all))
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), F.col(class_col)))
    return q.withColumn("n", F.col("_base") + F.when(r <= F.col("_left"), 1).otherwise(0)).select(class_col, "n")


def stratified_split(df: DataFrame, class_col: str, id_col: str, test_size: float = 0.2,
                     seed: int = 42, split_col: str = "split") -> DataFrame:
    """Every row tagged 'train' or 'test'; per-class test quotas exact."""
    quota = lambda counts: stratified_quota(counts, class_col, test_size, "_n_rows")
    out = hash_cut(df, id_col, seed, quota, class_col=class_col)
    return out.withColumn(split_col, F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def first_n(df: DataFrame, order_col: str, n: int, direct: int = DIRECT) -> DataFrame:
    """The ``n`` rows with the smallest ``order_col`` (unique, numeric; all
    rows where fewer exist): a threshold and a filter, no top-n merge."""
    limit = nth(df, [order_col], n, direct)
    if limit is not None:
        return df.where(_upto([order_col], limit))
    return df if n > 0 else df.limit(0)


def split_positional(df: DataFrame, order_col: str, train_fraction: float = 0.9,
                     split_col: str = "split", direct: int = DIRECT) -> DataFrame:
    """First int(N * fraction) rows in ``order_col`` order (unique,
    numeric) are 'train', the rest 'val'."""
    n_rows = df.count()
    n_train = int(n_rows * float(train_fraction))  # int(N * fraction), as in a Python slice bound
    limit = nth(df, [order_col], n_train, direct)
    train = _upto([order_col], limit) if limit is not None else F.lit(n_train > 0)
    return df.withColumn(split_col, F.when(train, "train").otherwise("val"))


def random_row(df: DataFrame, id_col: str, seed: int = 42, k: int = 1) -> DataFrame:
    """``k`` seeded random rows (top-k by hash: TakeOrdered, no full sort)."""
    h = seeded_hash(id_col, seed)
    return df.withColumn("_h", h).orderBy("_h", id_col).limit(k).drop("_h")


def head_per_group(df: DataFrame, group_col: str, order_col: str, n: int) -> DataFrame:
    """First ``n`` rows of each group (groups are bounded chunks; Spark
    plans a per-group limit before the window)."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, order_col: str, n: int = 100, tie: str | None = None) -> DataFrame:
    """Newest ``n`` rows by ``order_col`` (then ``tie``) descending
    (TakeOrdered)."""
    return df.orderBy(*[F.col(c).desc() for c in (order_col, tie) if c]).limit(n)
