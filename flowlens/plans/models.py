"""Model queries.

Learned predictions cannot be said in SQL.  Each query gives what can be: the
ids, truths and split of the rows that the model scored, and checks of its
output (predictions in the label domain, confidences in range, accuracy on
the training rows not below always guessing their larger class), which the
oracle states as true.

Training data: the 78-slot features of the closed flows, label 1 for
attack flows (substring rule), stratified 80/20 split by flow id.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions import votes as V
from flowlens.operators import features as feat
from flowlens.operators import metrics as MT
from flowlens.operators import mlp as MLP
from flowlens.operators import models as MD
from flowlens.operators import sampling as SM
from flowlens.plans import flows as FL
from flowlens.plans.registry import query
from flowlens.plans.sampling import split_ctes
from flowlens.session import checkpoint_dir, reliable_checkpoint
from flowlens.sources import io as IO
from flowlens.sources import fixtures as fx

FEATURES = feat.FEATURE_NAMES


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FL._flows(spark, sf_dir)
    x = feat.flow_features_78(f, keep=["close_id", "label"])
    x = x.withColumn("y", L.binary_contains(F.col("label")).cast("double")).drop("label")
    # the models scan this many times: cut the lineage once, reliably
    return reliable_checkpoint(SM.stratified_split(x, "y", "close_id", 0.2, MD.SEED))


#: The training set's ids, truths and split in SQL.
SPLIT_SQL = FL._flow_rows_sql(FL.TIMEOUT_S) + """,
fl AS (SELECT close_id, CASE WHEN upper(trim(label)) LIKE '%BENIGN%' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM agg),
""" + split_ctes("fl", "close_id", "y")


def model_sql(body: str) -> str:
    return fx.with_views(SPLIT_SQL + "\n" + body, "packets")


def domain_ok(name: str) -> Column:
    return F.coalesce(F.col(f"pred_{name}").isin(0, 1), F.lit(False))


def confidence_ok(name: str) -> Column:
    """Of two classes the larger probability is at least one half."""
    c = F.col(f"conf_{name}")
    return F.coalesce((c >= 0.5 - 1e-9) & (c <= 1 + 1e-9), F.lit(False))


def _tested(spark, sf_dir, kind, **kw):
    """Test rows scored by a model of ``kind``, with the checks."""
    data = training_set(spark, sf_dir)
    train = data.where("split = 'train'").drop("split")
    model = MD.fit_cached(MD.make_pipeline(train, FEATURES, kind, **kw), train)
    out = reliable_checkpoint(MD.score(model, data, kind).select("close_id", "y", "split", f"pred_{kind}", f"conf_{kind}"))
    row = out.where("split = 'train'").agg(F.avg((F.col("y") == F.col(f"pred_{kind}")).cast("double")).alias("acc"),
                                           F.avg("y").alias("ones")).first()  # two numbers
    fits = row["acc"] is None or row["acc"] >= max(row["ones"], 1 - row["ones"])
    return out.where("split = 'test'").select("close_id", "y", domain_ok(kind).alias("pred_ok"),
                                              confidence_ok(kind).alias("conf_ok"), F.lit(fits).alias("fits_train"))


TESTED_SQL = model_sql("""SELECT id AS close_id, cls AS y, true AS pred_ok, true AS conf_ok, true AS fits_train
FROM split WHERE split = 'test'""")


@query("model_rf", TESTED_SQL)
def model_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: random forest (100 trees, seed 42), test split."""
    return _tested(spark, sf_dir, "rf")


@query("model_lr", TESTED_SQL)
def model_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: logistic regression (1000 iterations, C = 1)."""
    return _tested(spark, sf_dir, "lr")


@query("model_mlp", TESTED_SQL)
def model_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: multilayer perceptron (100, 50), 500 iterations."""
    return _tested(spark, sf_dir, "mlp", **MD.MLP_CONFIGS["standard"])


@query("model_mlp_fast_full", TESTED_SQL)
def model_mlp_fast_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: multilayer perceptron (80, 40), batch 256."""
    return _tested(spark, sf_dir, "mlp", **MD.MLP_CONFIGS["fast_full"])


@query("model_mlp_flow", TESTED_SQL)
def model_mlp_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: multilayer perceptron (128, 64), 300 iterations."""
    return _tested(spark, sf_dir, "mlp", **MD.MLP_CONFIGS["flow"])


@query("pipeline_rf", model_sql("SELECT id AS close_id, split, true AS pred_ok, true AS conf_ok FROM split"))
def pipeline_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaler + RF (200 trees) pipeline saved, loaded back, applied."""
    data = training_set(spark, sf_dir)
    train = data.where("split = 'train'").drop("split")
    model = MD.fit_cached(MD.make_pipeline(train, FEATURES, "rf", trees=MD.RF_TREES_FLOW), train)
    path = os.path.join(checkpoint_dir(spark), "models", f"rf-{uuid.uuid4().hex}")
    MD.save_model(model, path)
    loaded = MD.load_models({"rf": path, "missing": path + "-absent"})["rf"]
    return MD.score(loaded, data, "rf").select("close_id", "split", domain_ok("rf").alias("pred_ok"),
                                               confidence_ok("rf").alias("conf_ok"))


NAMES = ("rf", "lr", "mlp")


def scored_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows scored by three models, with the ensemble."""
    data = training_set(spark, sf_dir)
    train = data.where("split = 'train'").drop("split")
    out = data
    for kind in NAMES:
        out = MD.score(MD.fit_cached(MD.make_pipeline(train, FEATURES, kind), train), out, kind)
    return reliable_checkpoint(out.select(
        "close_id", "split", "y", *[c for n in NAMES for c in (f"pred_{n}", f"conf_{n}")],
        V.plurality_vote([f"pred_{n}" for n in NAMES]).alias("pred_ensemble"),
        V.mean_ignoring_nan([f"conf_{n}" for n in NAMES]).alias("conf_ensemble")))


@query("score_confidence", model_sql("""
SELECT id AS close_id, split, cls AS y, true AS pred_ok, true AS conf_ok, true AS ensemble_ok FROM split"""))
def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows scored by three models, plus the ensemble, whose
    vote and mean confidence are checked against plain arithmetic."""
    s = scored_by_all(spark, sf_dir)
    ones = sum(F.col(f"pred_{n}") for n in NAMES)
    mean = sum(F.col(f"conf_{n}") for n in NAMES) / len(NAMES)
    vote = (F.col("pred_ensemble") == (ones >= 2).cast("int")) & (F.abs(F.col("conf_ensemble") - mean) < 1e-9)

    def every(check):
        out = F.lit(True)
        for n in NAMES:
            out = out & check(n)
        return out
    return s.select("close_id", "split", "y", every(domain_ok).alias("pred_ok"),
                    every(confidence_ok).alias("conf_ok"), vote.alias("ensemble_ok"))


@query("model_eval", model_sql("""
SELECT m.model, (SELECT count(*) FROM split WHERE split = 'test')::BIGINT AS n_rows, true AS accuracy_ok, true AS f1_ok
FROM (VALUES ('rf'), ('lr'), ('mlp'), ('ensemble')) AS m(model)"""))
def model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and weighted F1 of each model on the test split, checked
    for range."""
    s = scored_by_all(spark, sf_dir).where("split = 'test'")
    lp = MT.long_predictions(s, "y", {n: F.col(f"pred_{n}").cast("double") for n in (*NAMES, "ensemble")})
    cc = MT.confusion_counts(lp)
    rows = cc.groupBy("model").agg(F.sum("n").cast("long").alias("n_rows"))
    return rows.join(MT.accuracy(lp), "model").join(MT.f1_weighted(cc), "model").select(
        "model", "n_rows", F.col("accuracy").between(0, 1).alias("accuracy_ok"),
        F.col("f1_weighted").between(0, 1 + 1e-9).alias("f1_ok"))


def _scaled_split(spark: SparkSession, sf_dir: str):
    """All rows scaled on the training rows' 90 % head, and that head and its
    tail (positional cut by flow id)."""
    data = training_set(spark, sf_dir)
    pos = SM.split_positional(data.where("split = 'train'").drop("split"), "close_id", 0.9, split_col="part")
    pos = reliable_checkpoint(pos)
    scale = MD.scaler_stage(pos.where("part = 'train'"), FEATURES)
    scaled = reliable_checkpoint(scale.transform(pos))
    return scale.transform(data), scaled.where("part = 'train'"), scaled.where("part = 'val'")


@query("model_mlp_adam", model_sql("""SELECT id AS close_id, cls AS y, true AS pred_ok, true AS conf_ok, true AS fits_train,
  true AS gradient_ok, true AS loss_ok, 80 AS epochs FROM split WHERE split = 'test'"""))
def model_mlp_adam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M5: relu layers (48, 24), Adam, mini-batches of 512, 80 epochs.
    Checked besides the output: the gradient against finite differences on 50
    rows, the last training loss below the initial and the first one, accuracy
    on the training rows not below their larger class."""
    data, train, val = _scaled_split(spark, sf_dir)
    net, state = MLP.train_adam(train, val, FEATURES, "close_id")
    some = train.orderBy("close_id").limit(50).select("y", *FEATURES).toPandas()
    x, y = some[FEATURES].to_numpy(float), some["y"].to_numpy(int)
    start = MLP.initial(net.layers)
    gradient_ok = MLP.gradient_error(net.flat, net.layers, x, y) < 1e-4 and MLP.gradient_error(start, net.layers, x, y) < 1e-4
    losses = [r[1] for r in state.rows]
    loss_ok = losses[-1] < losses[0] and losses[-1] < MLP.summed_loss(start, net.layers, x, y) / max(len(y), 1)
    out = reliable_checkpoint(net.score(data, FEATURES, "mlp").select("close_id", "y", "split", "pred_mlp", "conf_mlp"))
    row = out.where("split = 'train'").agg(F.avg((F.col("y") == F.col("pred_mlp")).cast("double")).alias("acc"),
                                           F.avg("y").alias("ones")).first()  # two numbers
    fits = row["acc"] is None or row["acc"] >= max(row["ones"], 1 - row["ones"])
    return out.where("split = 'test'").select(
        "close_id", "y", domain_ok("mlp").alias("pred_ok"), confidence_ok("mlp").alias("conf_ok"),
        F.lit(fits).alias("fits_train"), F.lit(bool(gradient_ok)).alias("gradient_ok"), F.lit(bool(loss_ok)).alias("loss_ok"),
        F.lit(len(state.rows)).alias("epochs"))


@query("mlp_early_stop", model_sql("""SELECT count(*) FILTER (WHERE rn <= floor(n * 0.9::DOUBLE))::BIGINT AS n_train,
  count(*) FILTER (WHERE rn > floor(n * 0.9::DOUBLE))::BIGINT AS n_val,
  true AS stopped_ok, true AS best_ok, true AS resumed_ok, true AS logged_ok
FROM (SELECT row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM split WHERE split = 'train')"""))
def mlp_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training that stops when the validation loss has not
    improved for 5 epochs.  Checked: it stops then and not before; the kept
    network is that of the smallest validation loss; a run resumed from the
    stored state of its third epoch takes the same steps; the epoch rows are
    appended to the ``epochs`` table."""
    _, train, val = _scaled_split(spark, sf_dir)
    patience, most, at = 5, 60, 3
    base = os.path.join(checkpoint_dir(spark), "jobs", f"mlp-{uuid.uuid4().hex}")

    def keep(state):
        if state.epoch == at:
            MLP.save_state(spark, state, base + "/state")
    net, state = MLP.train_adam(train, val, FEATURES, "close_id", epochs=most, patience=patience, on_epoch=keep)
    losses = [r[2] for r in state.rows]
    early = [MLP.stale(state.rows[:k]) < patience for k in range(1, len(losses))]
    stopped = all(early) and (MLP.stale(state.rows) >= patience or len(losses) == most)
    held = MLP.Blocks(MLP.blocks(val, FEATURES, "close_id", "y", 1, 1, MLP.SEED), net.layers[0])
    best = abs(held.loss(net.flat, net.layers) - min(losses)) < 1e-9
    held.release()
    again, second = MLP.train_adam(train, val, FEATURES, "close_id", epochs=most, patience=patience,
                                   state=MLP.load_state(spark, base + "/state"))
    resumed = len(second.rows) == len(state.rows) and bool(np.allclose(again.flat, net.flat, rtol=0, atol=1e-9))
    table = IO.create_tables(spark, base, ["epochs"])["epochs"]
    IO.append(spark.createDataFrame(state.rows, IO.EPOCH_LOG), table)
    logged = [tuple(r) for r in spark.read.parquet(table).orderBy("epoch").collect()] == state.rows
    return spark.createDataFrame([(train.count(), val.count(), stopped, best, resumed, logged)],
                                 "n_train long, n_val long, stopped_ok boolean, best_ok boolean, resumed_ok boolean, "
                                 "logged_ok boolean")


@query("epoch_log", """SELECT range::INTEGER AS epoch, true AS loss_ok, true AS val_loss_ok, true AS time_ok,
  true AS improved FROM range(1, 81)""")
def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5/K9: 80 warm-started epochs of the fast MLP (48, 24), positional
    90/10 train/validation cut; the epoch log's rows with their checks (losses
    finite and not negative, the last loss below the first)."""
    data = training_set(spark, sf_dir).where("split = 'train'").drop("split")
    pos = reliable_checkpoint(SM.split_positional(data, "close_id", 0.9))
    train = MD.scaler_stage(pos, FEATURES).transform(pos)
    _, rows = MD.train_epochs(train.where("split = 'train'"), train.where("split = 'val'"), FEATURES)
    improved = rows[-1][1] < rows[0][1]

    def finite(x):
        return x is not None and 0 <= x < float("inf")
    return spark.createDataFrame([(e, finite(a), finite(b), t > 0, improved) for e, a, b, t in rows],
                                 "epoch int, loss_ok boolean, val_loss_ok boolean, time_ok boolean, improved boolean")
