"""Query registry: name -> (spark builder, oracle SQL or None).

Each plan module registers its queries with :func:`query`; the entry module
collects them.  Builders take ``(spark, sf_dir)`` and return a lazy
DataFrame; oracle SQL is DuckDB SQL over the driver's table views.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator registering a builder and, when given, its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    # importing the plan modules fills the registry
    from flowlens.plans import (  # noqa: F401
        flows, cleaning, scaling, sampling, metrics, votes, rules, models, streams,
    )
