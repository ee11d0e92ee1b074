"""Training-corpus pipeline: toxicity, near-duplicates, benchmark, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and gives the rows that stay, with the columns of ``documents`` (the last one
gives packed pieces).  ``run`` applies them in order; each result is written
as Parquet in the shared checkpoint folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import latent, near_dedup, packing, toxicity
from flowlens.llm.common import stored, table
from flowlens.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, learned from the labelled rows among ``docs``."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group stays."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    ship_package(spark)
    return latent.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token windows."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("benchmark", drop_benchmark), ("packing", pack)]

#: No stage can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
