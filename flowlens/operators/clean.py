"""Cleaning and projection of flow tables (headers, labels, values, columns).

Every operator is one ``select``/``where`` so Catalyst can prune columns and
push filters into the scan.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import labels as L

# Fixed value: identifier columns dropped before training.
IDENTIFIER_COLUMNS = ("Flow ID", "Src IP", "Dst IP", "Timestamp")


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def find_label_column(columns: Sequence[str], exact_first: bool = True) -> str:
    """The exact ``Label`` column, else the first whose name contains
    'label' (case-insensitive); a table without one is an error."""
    if exact_first and "Label" in columns:
        return "Label"
    for c in columns:
        if "label" in c.lower():
            return c
    raise ValueError("no label column found")


def clean_labels(df: DataFrame, label_col: str | None = None) -> DataFrame:
    """Stripped headers, rows with a label, label in {BENIGN, ATTACK}.

    Empty label text counts as missing (as a CSV reader reads an empty cell).
    """
    df = strip_headers(df)
    lc = label_col or find_label_column(df.columns)
    lab = F.col(lc)
    return (df.where(lab.isNotNull() & (lab != ""))
              .withColumn(lc, L.canonical_label(lab)))


def binary_label(df: DataFrame, label_col: str = "Label", mode: str = "exact",
                 out: str = "y") -> DataFrame:
    """P5 (``exact``) or P6 (``contains``) 0/1 label."""
    fn = L.binary_exact if mode == "exact" else L.binary_contains
    return df.withColumn(out, fn(F.col(label_col)))


_NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType,
            T.DecimalType)


def finite_or_zero(df: DataFrame, exclude: Iterable[str] = ("Label",)) -> DataFrame:
    """+-inf, NaN and NULL become 0 in every numeric column but ``exclude``."""
    ex = set(exclude)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in ex or not isinstance(f.dataType, _NUMERIC):
            cols.append(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
            cols.append(F.when(bad, F.lit(0.0)).otherwise(c).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.coalesce(c, F.lit(0)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def downcast(df: DataFrame, label_col: str | None = "Label", keep: Iterable[str] = ()) -> DataFrame:
    """DOUBLE -> FLOAT, BIGINT -> INT, label -> TINYINT (via the P5 rule,
    since label text cannot be cast to a number).  Ids (``keep``) stay as they
    are, and only BIGINT columns whose measured range fits become INT."""
    keep = set(keep)
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType) and f.name not in keep]
    fits = set()
    if longs:  # one row: the ranges
        row = df.agg(*[fn(f"`{c}`").alias(f"{p}{i}") for i, c in enumerate(longs)
                       for p, fn in (("lo", F.min), ("hi", F.max))]).first()
        fits = {c for i, c in enumerate(longs) if row[f"lo{i}"] is None
                or (row[f"lo{i}"] >= -2**31 and row[f"hi{i}"] < 2**31)}
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == label_col:
            cols.append(L.binary_exact(c).cast("tinyint").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            cols.append(c.cast("float").alias(f.name))
        elif f.name in fits:
            cols.append(c.cast("int").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def drop_identifiers(df: DataFrame, names: Iterable[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """Drop identifier columns where present (absent names ignored)."""
    return df.drop(*[n for n in names if n in df.columns])


def split_xy(df: DataFrame, label_col: str = "Label") -> tuple[DataFrame, DataFrame]:
    """P10: features and label as two projections of the same plan."""
    return df.drop(label_col), df.select(label_col)


def align_features(df: DataFrame, required: Sequence[str], label_col: str = "Label",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Drop the label, add missing required columns as 0, drop extras,
    order columns as ``required``."""
    have = set(df.columns) - {label_col}
    cols = [F.col(f"`{c}`") if c in have else F.lit(0).alias(c) for c in required]
    return df.select(*keep, *cols)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row (benign, attack) under the substring rule."""
    is_benign = L.binary_contains(F.col(label_col)) == 0
    return df.agg(F.count_if(is_benign).alias("benign"), F.count_if(~is_benign).alias("attack"))


def require_both_classes(balance_row) -> None:
    """Fail unless both classes are present (on the one-row A6 result)."""
    if not balance_row["benign"] or not balance_row["attack"]:
        raise ValueError("both classes (BENIGN and ATTACK) are required")
