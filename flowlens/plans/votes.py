"""Vote, decision and prediction-binding queries.

The three model outputs are the deterministic stand-ins of the ``votes``
view; a model whose confidence is missing counts as failed for that row
(prediction NULL), as batch scoring reports failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import votes as V
from flowlens.functions.numeric import round_half_away as rnd
from flowlens.plans.registry import query
from flowlens.sources import fixtures as fx


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row model outputs; lr failed where its confidence is missing."""
    v = fx.votes(spark, sf_dir)
    return v.withColumn("pred_lr", F.when(F.col("conf_lr").isNotNull(), F.col("pred_lr")))


V_SQL = """v AS (SELECT row_id, y_true, pred_rf, CASE WHEN conf_lr IS NULL THEN NULL ELSE pred_lr END AS pred_lr,
  pred_mlp, conf_rf, conf_lr, conf_mlp, chunk_no, row_in_chunk FROM votes),
w AS (SELECT *, (pred_rf=1)::INT + coalesce((pred_lr=1)::INT, 0) + (pred_mlp=1)::INT AS n1,
  (pred_rf=0)::INT + coalesce((pred_lr=0)::INT, 0) + (pred_mlp=0)::INT AS n0 FROM v),
e AS (SELECT *, CASE WHEN n1 + n0 = 0 THEN NULL WHEN n1 > n0 THEN 1 ELSE 0 END AS pred_ensemble,
  (coalesce(conf_rf, 0) + coalesce(conf_lr, 0) + coalesce(conf_mlp, 0))
   / nullif((conf_rf IS NOT NULL)::INT + (conf_lr IS NOT NULL)::INT + (conf_mlp IS NOT NULL)::INT, 0) AS conf_ensemble
  FROM w)"""


def vsql(body: str) -> str:
    return fx.with_views(f"WITH {V_SQL}\n{body}", "votes")


MODELS = ("rf", "lr", "mlp")


@query("vote_plurality", vsql("SELECT row_id, pred_ensemble AS vote FROM e"))
def vote_plurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: plurality vote of three models, ties to the smaller label,
    failed (NULL) votes ignored."""
    s = scored(spark, sf_dir)
    return s.select("row_id", V.plurality_vote([f"pred_{m}" for m in MODELS]).alias("vote"))


@query("vote_plurality_pairs", vsql("""
SELECT row_id, CASE WHEN pred_rf IS NULL AND pred_mlp IS NULL THEN NULL
  WHEN coalesce((pred_rf=1)::INT,0) + coalesce((pred_mlp=1)::INT,0) > coalesce((pred_rf=0)::INT,0) + coalesce((pred_mlp=0)::INT,0)
  THEN 1 ELSE 0 END AS vote FROM e"""))
def vote_plurality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 with two voters: a 1-1 tie goes to the smaller label 0."""
    s = scored(spark, sf_dir)
    return s.select("row_id", V.plurality_vote(["pred_rf", "pred_mlp"]).alias("vote"))


@query("vote_majority_decision", vsql("""
SELECT row_id, CASE WHEN (pred_rf=1)::INT + (pred_lr=1)::INT + (pred_mlp=1)::INT > 1
  THEN 'DROP' ELSE 'ACCEPT' END AS decision,
  CASE WHEN (pred_rf=1)::INT + (pred_mlp=1)::INT > 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision_two,
  CASE WHEN pred_rf IS NULL OR pred_lr IS NULL OR pred_mlp IS NULL THEN -1 ELSE pred_rf END AS rf_after_failure
FROM e"""))
def vote_majority_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: DROP iff more than floor(n/2) models say 1 (3 models, and 2
    models where one vote of two is not enough); a missing vote is a failed
    model: ACCEPT, and every prediction of the row is -1."""
    s = scored(spark, sf_dir)
    return s.select("row_id", V.majority_decision([f"pred_{m}" for m in MODELS]).alias("decision"),
                    V.majority_decision(["pred_rf", "pred_mlp"]).alias("decision_two"),
                    V.failure_rule([f"pred_{m}" for m in MODELS])["pred_rf"].alias("rf_after_failure"))


@query("single_model_decision", vsql("""
SELECT row_id, CASE WHEN pred_rf = 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision FROM e"""))
def single_model_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's 1 -> DROP, else ACCEPT."""
    return scored(spark, sf_dir).select("row_id", V.single_model_decision("pred_rf").alias("decision"))


@query("first_enabled_model", vsql("""
SELECT row_id, coalesce(pred_lr, pred_mlp) AS pred,
  CASE WHEN coalesce(pred_lr, pred_mlp) = 1 THEN 'DROP' ELSE 'ACCEPT' END AS decision FROM e"""))
def first_enabled_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With rf disabled, the first enabled model (lr, else mlp) decides."""
    s = scored(spark, sf_dir)
    p = V.first_enabled(["pred_lr", "pred_mlp"])
    return s.select("row_id", p.alias("pred"), V.single_model_decision(p).alias("decision"))


@query("ensemble_confidence", vsql("SELECT row_id, round(conf_ensemble, 9) AS conf_ensemble FROM e"))
def ensemble_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the available confidences; none -> NULL."""
    s = scored(spark, sf_dir)
    return s.select("row_id", rnd(V.mean_ignoring_nan(["conf_rf", "conf_lr", "conf_mlp"]), 9).alias("conf_ensemble"))


def bind_models(s: DataFrame, models=MODELS, ensemble: bool = True) -> DataFrame:
    """One row per input row with pred_/conf_ per selected model and
    the ensemble columns (NULL when the ensemble is off)."""
    cols = ["row_id"]
    for m in models:
        cols += [f"pred_{m}", f"conf_{m}"]
    out = s.select(*cols)
    if ensemble:
        return out.withColumns({
            "pred_ensemble": V.plurality_vote([f"pred_{m}" for m in models]),
            "conf_ensemble": V.mean_ignoring_nan([f"conf_{m}" for m in models])})
    return out.withColumns({"pred_ensemble": F.lit(None).cast("int"),
                            "conf_ensemble": F.lit(None).cast("double")})


@query("model_bind", vsql("""
SELECT row_id, pred_rf, conf_rf, pred_lr, conf_lr, pred_mlp, conf_mlp, pred_ensemble,
  round(conf_ensemble, 9) AS conf_ensemble FROM e"""))
def model_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of all models side by side plus the ensemble."""
    return bind_models(scored(spark, sf_dir)).withColumn("conf_ensemble", rnd("conf_ensemble", 9))


@query("score_without_ensemble", vsql("""
SELECT row_id, pred_rf, conf_rf, pred_mlp, conf_mlp, NULL::INTEGER AS pred_ensemble,
  NULL::DOUBLE AS conf_ensemble FROM e"""))
def score_without_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models rf and mlp selected, ensemble off (columns empty)."""
    return bind_models(scored(spark, sf_dir), ("rf", "mlp"), ensemble=False)


@query("predictions_vs_truth", fx.with_views(f"WITH {V_SQL}" + """,
truth AS (SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)
SELECT e.row_id, e.pred_ensemble, t.y FROM e JOIN truth t ON e.row_id = t.row_id
WHERE e.pred_ensemble IS NOT NULL""", "votes"))
def predictions_vs_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined to the label table on row id (not position);
    rows without an ensemble prediction dropped."""
    pred = bind_models(scored(spark, sf_dir)).select("row_id", "pred_ensemble")
    truth = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))
    return pred.join(truth, "row_id", "inner").where(F.col("pred_ensemble").isNotNull())
