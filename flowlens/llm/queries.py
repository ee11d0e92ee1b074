"""Registered queries of the numbered operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import byte_codec, collocations, html_text, latent, licenses, near_dedup, order_minhash, packing, preference, tokens, toxicity, \
    vector_codes, warc
from flowlens.llm.common import table
from flowlens.session import checkpoint_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    return preference.preference_pairs(table(spark, sf_dir, "conversations"))


ORACLE["op1_preference_pairs"] = preference.ORACLE


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE["op4_warc"] = warc.oracle_sql()


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


ORACLE["op11_vector_codes"] = vector_codes.oracle_sql()


@query
def op12_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.round_trip(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = collocations.oracle_sql()
