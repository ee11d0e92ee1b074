"""Vote and decision expressions over per-model prediction columns.

All are higher-order array expressions evaluated in the JVM (no UDF).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DROP = "DROP"
ACCEPT = "ACCEPT"
FAILED = -1


def _arr(cols: Sequence[str | Column]) -> Column:
    return F.array(*[F.col(c) if isinstance(c, str) else c for c in cols])


def plurality_vote(cols: Sequence[str | Column]) -> Column:
    """M8: most frequent prediction; ties go to the smallest label; NULL
    votes are ignored; all NULL -> NULL."""
    p = F.filter(_arr(cols), lambda x: x.isNotNull())
    cand = F.transform(F.array_distinct(p), lambda v: F.struct(
        (-F.size(F.filter(p, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.array_min(cand)["v"]


def majority_decision(cols: Sequence[str | Column]) -> Column:
    """M9: DROP iff the number of 1-votes exceeds floor(n / 2), else ACCEPT.
    No models -> ACCEPT; a failed model (a NULL or -1 vote) -> ACCEPT."""
    if not cols:
        return F.lit(ACCEPT)
    p = _arr(cols)
    failed = F.exists(p, lambda x: x.isNull() | (x == FAILED))
    ones = F.size(F.filter(p, lambda x: x == 1))
    return F.when(~failed & (ones > F.floor(F.size(p) / 2)), F.lit(DROP)).otherwise(F.lit(ACCEPT))


def failure_rule(cols: Sequence[str]) -> dict[str, Column]:
    """M9: one failed model makes every prediction of the flow -1."""
    failed = F.exists(_arr(cols), lambda x: x.isNull() | (x == FAILED))
    return {c: F.when(failed, F.lit(FAILED)).otherwise(F.col(c)) for c in cols}


def single_model_decision(col: str | Column) -> Column:
    """Prediction 1 -> DROP, anything else -> ACCEPT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == 1, F.lit(DROP)).otherwise(F.lit(ACCEPT))


def first_enabled(cols: Sequence[str]) -> Column:
    """Prediction of the first enabled model (order rf, lr, mlp)."""
    return F.coalesce(*[F.col(c) for c in cols]) if cols else F.lit(None).cast("int")


def mean_ignoring_nan(cols: Sequence[str | Column]) -> Column:
    """Mean of the non-missing confidences; none -> NULL."""
    v = F.filter(_arr(cols), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(v) > 0, total / F.size(v))


def predictions_map(names: Sequence[str], cols: Sequence[str]) -> Column:
    """The per-model prediction dict of a flow decision, as MAP<STRING,INT>."""
    if not names:
        return F.create_map().cast("map<string,int>")
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), _arr(cols))
