"""Scaler fit and apply (A8, J3) over lineitem's numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.numeric import round_half_away as rnd
from flowlens.operators import scale as S
from flowlens.plans.registry import query
from flowlens.sources import fixtures as fx

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_zero"]


def _lineitem(spark, sf_dir):
    # l_zero is a constant column derived from the table (std 0 -> 1)
    return fx.table(spark, sf_dir, "lineitem").withColumn("l_zero", F.col("l_quantity") * 0)


def _stats_sql() -> str:
    sel = ", ".join(
        f"avg({c}) AS {c}__mean, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}__std"
        for c in COLS)
    return f"s AS (SELECT {sel} FROM (SELECT *, l_quantity * 0 AS l_zero FROM lineitem))"


@query("scaler_fit", "WITH " + _stats_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round({c}__mean, 6) AS mean, round({c}__std, 6) AS std FROM s" for c in COLS))
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-feature mean and population std (0 -> 1)."""
    t = S.scaler_table(S.fit_scaler(_lineitem(spark, sf_dir), COLS), COLS)
    return t.select("feature", rnd("mean", 6).alias("mean"), rnd("std", 6).alias("std"))


@query("standard_scale", "WITH " + _stats_sql() + "\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round((l.{c} - s.{c}__mean) / s.{c}__std, 6) AS {c}" for c in COLS)
    + "\nFROM (SELECT *, l_quantity * 0 AS l_zero FROM lineitem) l, s")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scaled with the fitted stats (one-row broadcast)."""
    li = _lineitem(spark, sf_dir)
    out = S.apply_scaler(li.select("l_orderkey", "l_linenumber", *COLS), S.fit_scaler(li, COLS), COLS)
    return out.select("l_orderkey", "l_linenumber", *[rnd(c, 6).alias(c) for c in COLS])
