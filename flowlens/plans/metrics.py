"""Metric queries (A9-A15, M13, T1 over the run log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import votes as V
from flowlens.functions.numeric import round_half_away as rnd
from flowlens.operators import metrics as M
from flowlens.operators import sampling as SM
from flowlens.plans.registry import query
from flowlens.plans.votes import MODELS, V_SQL, scored
from flowlens.sources import fixtures as fx

LP_SQL = V_SQL + """,
lp AS (SELECT 'rf' AS model, y_true AS y, pred_rf AS p, conf_rf AS conf FROM e
  UNION ALL SELECT 'lr', y_true, pred_lr, conf_lr FROM e WHERE pred_lr IS NOT NULL
  UNION ALL SELECT 'mlp', y_true, pred_mlp, conf_mlp FROM e
  UNION ALL SELECT 'ensemble', y_true, pred_ensemble, conf_ensemble FROM e WHERE pred_ensemble IS NOT NULL),
cc AS (SELECT model, y, p, count(*) AS n FROM lp GROUP BY model, y, p),
labels AS (SELECT model, y AS label FROM cc UNION SELECT model, p FROM cc),
pc0 AS (SELECT l.model, l.label,
  sum(CASE WHEN cc.y = l.label THEN n ELSE 0 END)::BIGINT AS support,
  sum(CASE WHEN cc.p = l.label THEN n ELSE 0 END)::BIGINT AS predicted,
  sum(CASE WHEN cc.y = l.label AND cc.p = l.label THEN n ELSE 0 END)::BIGINT AS tp
  FROM labels l JOIN cc ON cc.model = l.model GROUP BY l.model, l.label),
pc1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM pc1)"""


def msql(body: str) -> str:
    return fx.with_views(f"WITH {LP_SQL}\n{body}", "votes")


def long_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumns({
        "pred_ensemble": V.plurality_vote([f"pred_{m}" for m in MODELS]),
        "conf_ensemble": V.mean_ignoring_nan([f"conf_{m}" for m in MODELS])})
    names = (*MODELS, "ensemble")
    return M.long_predictions(s, "y_true", {m: f"pred_{m}" for m in names},
                              extra={"conf": {m: f"conf_{m}" for m in names}})


@query("metric_accuracy", msql("SELECT model, count_if(y = p) / count(*) AS accuracy FROM lp GROUP BY model"))
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 per model and for the ensemble."""
    return M.accuracy(long_preds(spark, sf_dir))


@query("metric_f1_weighted", msql("""
SELECT model, round(sum(support * f1) / sum(support), 6) AS f1_weighted FROM pc GROUP BY model"""))
def metric_f1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: support-weighted F1 over the label union."""
    f = M.f1_weighted(M.confusion_counts(long_preds(spark, sf_dir)))
    return f.select("model", rnd("f1_weighted", 6).alias("f1_weighted"))


@query("confusion_matrix", msql("""
SELECT a.model, a.label AS y_true, b.label AS y_pred, coalesce(cc.n, 0)::BIGINT AS n
FROM labels a JOIN labels b ON a.model = b.model
LEFT JOIN cc ON cc.model = a.model AND cc.y = a.label AND cc.p = b.label"""))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full label-union grid with zero cells."""
    return M.confusion_matrix(M.confusion_counts(long_preds(spark, sf_dir)))


@query("classification_report", msql("""
SELECT model, CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM pc
UNION ALL SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM pc GROUP BY model
UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  sum(support)::BIGINT FROM pc GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  sum(support)::BIGINT FROM pc GROUP BY model"""))
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class rows plus accuracy, macro and weighted averages."""
    r = M.classification_report(M.confusion_counts(long_preds(spark, sf_dir)))
    return r.select("model", "label", *[rnd(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("log_loss", msql("""
SELECT model, round(-avg(ln(CASE WHEN p = y THEN conf ELSE 1 - conf END)), 6) AS log_loss
FROM lp WHERE conf IS NOT NULL GROUP BY model"""))
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the true class = confidence when the prediction
    is right, 1 - confidence otherwise; rows without a confidence skipped."""
    lp = long_preds(spark, sf_dir).where(F.col("conf").isNotNull())
    lp = lp.withColumn("p_true", F.when(F.col("p") == F.col("y"), F.col("conf")).otherwise(1 - F.col("conf")))
    return M.log_loss(lp).select("model", rnd("log_loss", 6).alias("log_loss"))


CHUNK_SQL = """, ca AS (SELECT chunk_no, count_if(y_true = pred_mlp) / count(*) AS accuracy, count(*)::BIGINT AS n_rows
  FROM e GROUP BY chunk_no)"""


@query("chunk_accuracy", fx.with_views(f"WITH {V_SQL}{CHUNK_SQL}\nSELECT * FROM ca", "votes"))
def chunk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mlp accuracy of every chunk."""
    return M.chunk_accuracy(scored(spark, sf_dir), "chunk_no", "row_in_chunk", "y_true", "pred_mlp")


@query("mean_chunk_accuracy", fx.with_views(
    f"WITH {V_SQL}{CHUNK_SQL}\nSELECT round(avg(accuracy), 9) AS mean_accuracy, count(*)::BIGINT AS n_chunks FROM ca",
    "votes"))
def mean_chunk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted mean of the chunk accuracies."""
    ca = M.chunk_accuracy(scored(spark, sf_dir), "chunk_no", "row_in_chunk", "y_true", "pred_mlp")
    return M.mean_chunk_accuracy(ca).select(rnd("mean_accuracy", 9).alias("mean_accuracy"), "n_chunks")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7 rows: one evaluation run per chunk (id = chunk number)."""
    ca = M.chunk_accuracy(scored(spark, sf_dir), "chunk_no", "row_in_chunk", "y_true", "pred_mlp")
    return ca.select(F.col("chunk_no").alias("id"), F.lit("chunk_eval").alias("script"),
                     F.col("n_rows").cast("int").alias("n_rows"), F.lit("mlp").alias("models_used"),
                     F.lit(0).alias("ensemble_used"), "accuracy",
                     F.lit(None).cast("double").alias("f1_score"), F.lit(None).cast("string").alias("notes"))


@query("latest_rows", fx.with_views(f"WITH {V_SQL}{CHUNK_SQL}" + """
SELECT chunk_no AS id, 'chunk_eval' AS script, CAST(n_rows AS INTEGER) AS n_rows, 'mlp' AS models_used,
  0 AS ensemble_used, accuracy, NULL::DOUBLE AS f1_score, NULL::VARCHAR AS notes
FROM ca QUALIFY row_number() OVER (ORDER BY chunk_no DESC) <= 3""", "votes"))
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run-log rows by id descending (3 of the chunk runs)."""
    return SM.latest(run_log(spark, sf_dir), "id", 3)
