"""Classification metrics as aggregations.

Everything starts from the confusion counts ``groupBy(model, y, p).count()``
(partial aggregation: the shuffle carries at most models x classes^2 rows
per partition), so accuracy, F1, the confusion matrix and the report are
small follow-up computations over a table bounded by the class count.
Several models are scored in one pass by stacking their predictions into
(model, y, p) rows.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_predictions(df: DataFrame, y_col: str, preds: Mapping[str, str | Column],
                     extra: Mapping[str, Mapping[str, str | Column]] | None = None) -> DataFrame:
    """(model, y, p[, extra...]) rows, one per model and input row, NULL
    predictions dropped (a failed model has no vote for that row)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    structs = []
    for name, p in preds.items():
        fields = [F.lit(name).alias("model"), c(y_col).alias("y"), c(p).alias("p")]
        for k, per_model in (extra or {}).items():
            fields.append(c(per_model[name]).alias(k))
        structs.append(F.struct(*fields))
    return (df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
              .where(F.col("p").isNotNull()))


def confusion_counts(lp: DataFrame, materialize: bool = True) -> DataFrame:
    """(model, y, p, n).  The table has at most models x classes^2 rows and
    every metric reads it several times, so it is materialised once (in the
    shared checkpoint folder) and the predictions are scanned once."""
    cc = lp.groupBy("model", "y", "p").agg(F.count(F.lit(1)).alias("n"))
    if materialize:
        from flowlens.session import reliable_checkpoint
        cc = reliable_checkpoint(cc)
    return cc


def accuracy(lp: DataFrame) -> DataFrame:
    """A9 per model: share of rows with y == p."""
    return lp.groupBy("model").agg(
        (F.count_if(F.col("y") == F.col("p")) / F.count(F.lit(1))).alias("accuracy"))


def per_class(cc: DataFrame) -> DataFrame:
    """Per (model, label): tp, support (true count), predicted count,
    precision, recall, f1 (0 where undefined).  Labels = union of truth and
    prediction labels of that model."""
    true_n = cc.groupBy("model", F.col("y").alias("label")).agg(F.sum("n").alias("support"))
    pred_n = cc.groupBy("model", F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    tp = cc.where(F.col("y") == F.col("p")).select("model", F.col("y").alias("label"), F.col("n").alias("tp"))
    t = (true_n.join(pred_n, ["model", "label"], "full").join(tp, ["model", "label"], "left")
               .na.fill(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def f1_weighted(cc: DataFrame) -> DataFrame:
    """A10: sum over labels of support/N * F1."""
    pc = per_class(cc)
    return pc.groupBy("model").agg(
        (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1_weighted"))


def confusion_matrix(cc: DataFrame) -> DataFrame:
    """Every (true, predicted) pair over the model's sorted label union,
    zeros included.  The label set is a class domain (a handful of values),
    so the label x label grid is tiny."""
    labels = (cc.select("model", F.col("y").alias("label"))
                .union(cc.select("model", F.col("p").alias("label"))).distinct())
    grid = (labels.withColumnRenamed("label", "y_true")
                  .join(labels.withColumnRenamed("label", "y_pred"), "model"))
    return (grid.join(cc.withColumnsRenamed({"y": "y_true", "p": "y_pred"}), ["model", "y_true", "y_pred"], "left")
                .select("model", "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def classification_report(cc: DataFrame) -> DataFrame:
    """Per class precision/recall/f1/support, then 'accuracy',
    'macro avg' and 'weighted avg' rows."""
    pc = per_class(cc)
    cls = pc.select("model", F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                    F.col("support").cast("long").alias("support"))
    tot = pc.groupBy("model").agg(
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("_wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("_wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("_wf"))
    null = F.lit(None).cast("double")
    acc = tot.select("model", F.lit("accuracy").alias("label"), null.alias("precision"), null.alias("recall"),
                     (F.col("_tp") / F.col("_n")).alias("f1"), F.col("_n").cast("long").alias("support"))
    mac = tot.select("model", F.lit("macro avg").alias("label"), F.col("_mp").alias("precision"),
                     F.col("_mr").alias("recall"), F.col("_mf").alias("f1"), F.col("_n").cast("long").alias("support"))
    wei = tot.select("model", F.lit("weighted avg").alias("label"), F.col("_wp").alias("precision"),
                     F.col("_wr").alias("recall"), F.col("_wf").alias("f1"), F.col("_n").cast("long").alias("support"))
    return cls.unionByName(acc).unionByName(mac).unionByName(wei)


def log_loss(lp: DataFrame, prob_col: str = "p_true") -> DataFrame:
    """-mean(ln p_true) per model, no clipping: p = 0 gives +inf
    (Spark's ln(0) is NULL, so that case is mapped explicitly)."""
    p = F.col(prob_col)
    term = F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log(p))
    return lp.groupBy("model").agg((-F.avg(term)).alias("log_loss"))


def chunk_accuracy(df: DataFrame, chunk_col: str, row_col: str, y_col: str, p_col: str, head: int | None = None) -> DataFrame:
    """Accuracy of each chunk, of its first ``head`` rows where given."""
    h = df
    if head is not None:
        w = Window.partitionBy(chunk_col).orderBy(row_col)
        h = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= head)
    return h.groupBy(chunk_col).agg(
        (F.count_if(F.col(y_col) == F.col(p_col)) / F.count(F.lit(1))).alias("accuracy"),
        F.count(F.lit(1)).alias("n_rows"))


def mean_chunk_accuracy(chunks: DataFrame) -> DataFrame:
    """Unweighted mean of the per-chunk accuracies (NULL when none)."""
    return chunks.agg(F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_chunks"))
