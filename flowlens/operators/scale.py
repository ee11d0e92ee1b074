"""Standard scaler as expressions: population std, constant columns kept.

Fit is one aggregate (partial + final, mergeable across files, so an
incremental fit over many inputs is the same job); apply joins the one-row
stats table, which is broadcast (its size is fixed by the column count).
Spark ML's ``StandardScaler`` uses the sample std and maps constant columns
to 0, which is a different transform, so it is not used here.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``<c>__mean`` and ``<c>__std`` (0 std -> 1)."""
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        aggs.append(F.avg(x).alias(f"{c}__mean"))
        sd = F.stddev_pop(x)
        aggs.append(F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__std"))
    return df.agg(*aggs)


def scaler_table(stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The fitted stats as (feature, mean, std) rows."""
    parts = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in cols)
    return stats.selectExpr(f"stack({len(cols)}, {parts}) AS (feature, mean, std)")


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std per column, other columns untouched."""
    row = stats.first()  # one row, its size fixed by the column count
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(row[f"{c}__mean"])) / F.lit(row[f"{c}__std"]) for c in cols})
