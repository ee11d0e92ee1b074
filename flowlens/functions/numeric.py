"""Numeric presentation helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c, digits: int = 6) -> Column:
    """Round to ``digits`` decimals, halves away from zero, computed on the
    binary value as ``floor(|x| * 10^d + 0.5) / 10^d`` (the way SQL engines
    such as DuckDB round doubles).  ``F.round`` instead rounds the shortest
    decimal text of the double, which can differ on exact halves."""
    x = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m)
