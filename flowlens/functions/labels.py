"""Label rules.  Three rules exist and they disagree on purpose:

* canonical: ``upper(label) == 'BENIGN'`` -> 'BENIGN', else 'ATTACK' (no trim)
* exact:     ``label == 'BENIGN'`` (case-sensitive) -> 0, else 1, NULL -> 1
* contains:  ``'BENIGN' in upper(trim(label))`` -> 0, else 1, NULL -> 1
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BENIGN = "BENIGN"
ATTACK = "ATTACK"


def canonical_label(c: Column) -> Column:
    return F.when(F.upper(c) == BENIGN, F.lit(BENIGN)).otherwise(F.lit(ATTACK))


def binary_exact(c: Column) -> Column:
    return F.when(c == BENIGN, F.lit(0)).otherwise(F.lit(1))


def binary_contains(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).contains(BENIGN), F.lit(0)).otherwise(F.lit(1))
