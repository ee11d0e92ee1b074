"""Sampling, splitting and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import sampling as SM
from flowlens.plans.registry import query
from flowlens.sources import fixtures as fx

# The sample size and seed of the sampling step.
SAMPLE_N = 5_000
SEED = 42


def _sample_sql(n: int) -> str:
    return f"""SELECT o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, {SEED})), o_orderkey) <= {n}"""


@query("sample_exact_n", _sample_sql(SAMPLE_N))
def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: exactly 5,000 orders (all when fewer exist), seed 42."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return SM.sample_exact_n(o, SAMPLE_N, "o_orderkey", SEED)


@query("sample_exact_n_1000", _sample_sql(1000))
def sample_exact_n_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 with n below the table size: the seeded-hash exact cut."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return SM.sample_exact_n(o, 1000, "o_orderkey", SEED)


def split_ctes(src: str, id_col: str, cls: str) -> str:
    """CTEs ending in ``split(id, cls, split)``: the stratified 80/20 split."""
    return f"""base AS (SELECT {id_col} AS id, {cls} AS cls, md5(concat_ws('|', {id_col}, {SEED})) AS h FROM {src}),
cnt AS (SELECT cls, count(*) AS c FROM base GROUP BY cls),
tot AS (SELECT sum(c)::BIGINT AS n, CAST(ceil(0.2::DOUBLE * sum(c)::BIGINT) AS BIGINT) AS nt FROM cnt),
q AS (SELECT cls, (nt * c) // n AS b, (nt * c) % n AS rem, nt FROM cnt, tot),
q2 AS (SELECT cls, b + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= nt - sum(b) OVER () THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT base.*, row_number() OVER (PARTITION BY cls ORDER BY h, id) AS rn FROM base),
split AS (SELECT id, cls, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q2 USING (cls))"""


def _strat_sql(src: str, id_col: str, cls: str, views=()) -> str:
    sql = f"WITH {split_ctes(src, id_col, cls)}\nSELECT id AS {id_col}, cls AS {cls}, split FROM split"
    return fx.with_views(sql, *views) if views else sql


@query("stratified_split", _strat_sql("votes", "row_id", "y_true", ("votes",)))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 80/20 split with exact per-class quotas, seed 42."""
    v = fx.votes(spark, sf_dir).select("row_id", "y_true")
    return SM.stratified_split(v, "y_true", "row_id", 0.2, SEED)


@query("stratified_split_labels", _strat_sql("labels", "doc_id", "quality"))
def stratified_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 on the two-class quality labels (unbalanced classes)."""
    lab = fx.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return SM.stratified_split(lab, "quality", "doc_id", 0.2, SEED)


@query("split_positional", fx.with_views("""
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) <= floor(count(*) OVER () * 0.9::DOUBLE)
  THEN 'train' ELSE 'val' END AS split FROM votes""", "votes"))
def split_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First int(0.9 N) rows in row order train, the rest validation."""
    return SM.split_positional(fx.votes(spark, sf_dir).select("row_id"), "row_id", 0.9)


@query("chunk_head", fx.with_views("""
SELECT row_id, chunk_no, row_in_chunk FROM votes
QUALIFY row_number() OVER (PARTITION BY chunk_no ORDER BY row_in_chunk) <= 2000""", "votes"))
def chunk_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 rows of every chunk."""
    v = fx.votes(spark, sf_dir).select("row_id", "chunk_no", "row_in_chunk")
    return SM.head_per_group(v, "chunk_no", "row_in_chunk", 2000)
