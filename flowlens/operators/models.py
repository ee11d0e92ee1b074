"""Spark ML classifiers over flow features: pipelines, scoring, epochs.

Every stage is a built-in Spark ML stage, so a fitted ``PipelineModel`` saves
and loads with Spark's own writer.  The scaler is a ``SQLTransformer`` whose
statement carries the fitted population mean/std (see ``scale``), because
Spark's ``StandardScaler`` uses the sample std and zeroes constant columns.
"""

from __future__ import annotations

import time
from typing import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import votes as V
from flowlens.operators.scale import fit_scaler

# The model configurations (trees, iterations, layers, seed).
SEED = 42
RF_TREES = 100
RF_TREES_FLOW = 200
RF_MAX_DEPTH = 20          # Spark's cap is 30; unlimited depth is not available
LR_MAX_ITER = 1000
MLP_HIDDEN = (100, 50)
MLP_MAX_ITER = 500
MLP_FAST_HIDDEN = (48, 24)
MLP_BLOCK = 512
EPOCHS = 80
#: The MLP configurations: hidden layers, batch size, iterations.
MLP_CONFIGS = {"standard": {"hidden": (100, 50), "block": 256, "max_iter": 500},
               "fast_full": {"hidden": (80, 40), "block": 256, "max_iter": 500},
               "flow": {"hidden": (128, 64), "block": 256, "max_iter": 300},
               "fast": {"hidden": (48, 24), "block": 512, "max_iter": 1}}


def scaler_stage(train: DataFrame, cols: Sequence[str]) -> SQLTransformer:
    """Population-std scaler fitted on ``train`` as a serialisable stage."""
    row = fit_scaler(train, cols).first()  # one row, size fixed by the column count
    exprs = ", ".join(f"(`{c}` - {float(row[f'{c}__mean'])!r}) / {float(row[f'{c}__std'])!r} AS `{c}`"
                      for c in cols)
    scaled = ", ".join(f"`{c}`" for c in cols)
    stmt = f"SELECT * EXCEPT ({scaled}), {exprs} FROM __THIS__"
    return SQLTransformer(statement=stmt)


def layout_of(df: DataFrame, col: str = "f0") -> str | None:
    """The feature layout tag carried in the column metadata, if any."""
    from flowlens.operators.features import LAYOUT_KEY
    if col not in df.columns:
        return None
    return df.schema[col].metadata.get(LAYOUT_KEY)


def features_col(layout: str | None) -> str:
    """Vector column name; it records the layout inside the saved model."""
    return f"features_{layout}" if layout else "features"


def classifier(kind: str, n_features: int, n_train: int = 1, n_classes: int = 2, **kw):
    fc = kw.get("features_col", "features")
    if kind == "rf":
        return RandomForestClassifier(numTrees=kw.get("trees", RF_TREES), seed=SEED, maxDepth=RF_MAX_DEPTH,
                                      featureSubsetStrategy="sqrt", labelCol="y", featuresCol=fc)
    if kind == "lr":
        # sum-of-losses with C = 1 equals mean loss with regParam = 1 / n
        return LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, labelCol="y", featuresCol=fc)
    if kind == "mlp":
        hidden = kw.get("hidden", MLP_HIDDEN)
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes],
                                              maxIter=kw.get("max_iter", MLP_MAX_ITER),
                                              blockSize=kw.get("block", 256), seed=SEED,
                                              labelCol="y", featuresCol=fc)
    raise ValueError(f"unknown model kind {kind}")


def make_pipeline(train: DataFrame, feature_cols: Sequence[str], kind: str, **kw) -> Pipeline:
    """M4: scaler -> assembler -> classifier.  The vector column is named
    after the training data's feature layout, so the saved model remembers
    it and :func:`score` refuses rows of another layout."""
    n_train = kw.pop("n_train", None) or train.count()
    fc = features_col(layout_of(train, feature_cols[0]))
    return Pipeline(stages=[
        scaler_stage(train, feature_cols),
        VectorAssembler(inputCols=list(feature_cols), outputCol=fc, handleInvalid="keep"),
        classifier(kind, len(feature_cols), n_train, features_col=fc, **kw),
    ])


def fit_cached(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit with the training rows held in memory (spilling to disk) for the
    optimiser's many passes, released afterwards.  Lost blocks are rebuilt
    from the caller's (checkpointed) lineage."""
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(train)
    finally:
        train.unpersist()


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """M7: class and confidence (= the largest class probability) per row.
    D10: a model trained on one feature layout fails on another."""
    asm = [st for st in model.stages if isinstance(st, VectorAssembler)]
    fc = asm[0].getOutputCol() if asm else "features"
    want = fc[len("features_"):] if fc.startswith("features_") else None
    got = layout_of(df, asm[0].getInputCols()[0]) if asm else None
    if want and got and want != got:
        raise ValueError(f"model trained on layout {want!r}, rows are layout {got!r}")
    out = model.transform(df)
    return (out.withColumn(f"pred_{name}", F.col("prediction").cast("int"))
               .withColumn(f"conf_{name}", F.array_max(vector_to_array("probability")))
               .drop(fc, "rawPrediction", "probability", "prediction"))


def score_or_null(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """M7: as :func:`score`; a model that cannot be applied to these rows (its
    columns or layout are absent) gives NULL instead of failing the job."""
    try:
        return score(model, df, name)
    except (ValueError, AnalysisException, IllegalArgumentException) as e:
        print(f"model {name} gives no predictions: {type(e).__name__}")
        return df.withColumns({f"pred_{name}": F.lit(None).cast("int"), f"conf_{name}": F.lit(None).cast("double")})


class ModelVotes:
    """Features -> features with ``pred_<name>`` of every model, with the
    failure rule (one failed model: all predictions -1)."""

    def __init__(self, models: dict[str, PipelineModel], failed: Iterable[str] = ()):
        self.models, self.failed = models, frozenset(failed)

    def __call__(self, feats: DataFrame) -> DataFrame:
        out = feats
        for name, model in self.models.items():
            if name in self.failed:
                out = out.withColumn(f"pred_{name}", F.lit(None).cast("int"))
            else:
                out = score_or_null(model, out, name)
        return out.withColumns(V.failure_rule([f"pred_{n}" for n in self.models]))

    def without(self, failed: Iterable[str]) -> "ModelVotes":
        return ModelVotes(self.models, self.failed | set(failed))

    def failing(self, feats: DataFrame) -> set[str]:
        """The models that fail on these rows, each run alone."""
        out = set()
        for name, model in self.models.items():
            if name not in self.failed:
                try:
                    score_or_null(model, feats, name).select(f"pred_{name}").write.format("noop").mode("overwrite").save()
                except Exception:  # noqa: BLE001 - whatever a model raises in a task
                    out.add(name)
        return out


def model_votes(models: dict[str, PipelineModel]) -> ModelVotes:
    return ModelVotes(models)


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite-save a fitted pipeline."""
    model.write().overwrite().save(path)


def load_models(paths: dict[str, str]) -> dict[str, PipelineModel]:
    """Load what loads; a missing or broken model is skipped with a
    notice; no model at all is an error."""
    out = {}
    for name, p in paths.items():
        try:
            out[name] = PipelineModel.load(p)
        except Exception as e:  # noqa: BLE001 - any load failure skips the model
            print(f"model {name} skipped: {type(e).__name__}")
    if not out:
        raise RuntimeError("no model could be loaded")
    return out


def log_losses(model, tagged: DataFrame) -> dict:
    """Mean -ln p(true class) per ``part`` tag of ``tagged`` (one job for
    train and validation together; the result has one row per tag)."""
    out = model.transform(tagged).select(
        "part", F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1).alias("p"))
    term = F.when(F.col("p") == 0, F.lit(float("-inf"))).otherwise(F.log("p"))
    return {r["part"]: float(r["l"]) for r in out.groupBy("part").agg((-F.avg(term)).alias("l")).collect()}


def train_epochs(train: DataFrame, val: DataFrame, feature_cols: Sequence[str], epochs: int = EPOCHS,
                 hidden=MLP_FAST_HIDDEN, block: int = MLP_BLOCK, patience: int | None = None):
    """M5/M6: warm-started MLP, one optimiser iteration per epoch, with train
    and validation log loss and wall time per epoch; optional early stop
    when the validation loss has not improved for ``patience`` epochs.

    Returns (model, epoch rows): the model of the best validation loss when
    stopping early is asked for, else the last.  Inputs should be
    checkpointed by the caller: the loop scans them every epoch.
    """
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    # scanned every epoch: keep the assembled vectors (spillable; lost
    # blocks are recomputed from the caller's checkpointed input)
    both = asm.transform(train.withColumn("part", F.lit("train"))
                         .unionByName(val.withColumn("part", F.lit("val")))).persist(StorageLevel.MEMORY_AND_DISK)
    tr = both.where("part = 'train'")
    weights, model, kept, rows = None, None, None, []
    best, stale = float("inf"), 0
    for epoch in range(1, epochs + 1):
        t0 = time.time()
        mlp = classifier("mlp", len(feature_cols), hidden=hidden, block=block, max_iter=1)
        if weights is not None:
            mlp.setInitialWeights(weights)
        model = mlp.fit(tr)
        weights = model.weights
        ll = log_losses(model, both)
        loss, vloss = ll.get("train"), ll.get("val")
        rows.append((epoch, loss, vloss, time.time() - t0))
        if patience:
            if vloss < best:
                best, stale, kept = vloss, 0, model
            else:
                stale += 1
                if stale >= patience:
                    break
    both.unpersist()
    return (kept or model), rows
