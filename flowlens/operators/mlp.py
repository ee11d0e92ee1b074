"""M3, M5, M6: a multilayer perceptron with relu layers, trained by Adam on
mini-batches.

Rows are dealt once to batches by a seeded hash of their id and stored as
blocks (one row per block of at most ``BLOCK_ROWS`` rows, features as bytes).
A step sums the gradients of one batch's blocks, each in the task that holds
it, and the optimiser's update runs on the driver: what travels is one gradient
per block and the weights, whatever the number of rows.  A step runs tasks only
on the partitions that hold its batch.  Batches of more than ``BLOCK_ROWS`` rows
spread over several tasks; on large data raise ``batch`` with it.

The blocks are kept in memory or on disk; lost ones are rebuilt from the
checkpointed block table.  The optimiser's state after an epoch can be stored
and resumed: a resumed run takes the same steps as an uninterrupted one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import reliable_checkpoint

# Adam's and the penalty's usual settings.
RATE, BETA1, BETA2, EPSILON, ALPHA = 1e-3, 0.9, 0.999, 1e-8, 1e-4
BATCH = 512
EPOCHS = 80
BLOCK_ROWS = 8192
SEED = 42


def layer_shapes(layers: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(layers, layers[1:]))


def initial(layers: Sequence[int], seed: int = SEED) -> np.ndarray:
    """Uniform weights within sqrt(6 / (in + out)), biases alike; flat."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.uniform(-1, 1, a * b + b) * np.sqrt(6 / (a + b)) for a, b in layer_shapes(layers)])


def unpacked(flat: np.ndarray, layers: Sequence[int]):
    out, at = [], 0
    for a, b in layer_shapes(layers):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def probabilities(flat: np.ndarray, layers: Sequence[int], x: np.ndarray):
    """Class probabilities, and the activations of each layer."""
    seen, params = [x], unpacked(flat, layers)
    for n, (w, b) in enumerate(params):
        x = x @ w + b
        if n + 1 < len(params):
            x = np.maximum(x, 0)
            seen.append(x)
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True), seen


def summed_loss(flat, layers, x, y) -> float:
    p = probabilities(flat, layers, x)[0]
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())


def summed_gradient(flat, layers, x, y):
    """Summed log loss of the rows and its gradient (flat)."""
    p, seen = probabilities(flat, layers, x)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
    delta = p.copy()
    delta[np.arange(len(y)), y] -= 1
    out = []
    for (w, _), a in zip(reversed(unpacked(flat, layers)), reversed(seen)):
        out.append(np.concatenate([(a.T @ delta).ravel(), delta.sum(0)]))
        delta = (delta @ w.T) * (a > 0)
    return loss, np.concatenate(out[::-1])


def penalty(flat, layers) -> np.ndarray:
    """The weights (biases as 0): the gradient of half their squared sum."""
    return np.concatenate([np.concatenate([w.ravel(), np.zeros_like(b)]) for w, b in unpacked(flat, layers)])


@dataclass
class State:
    """Weights and optimiser after ``epoch`` epochs, with the epoch rows."""
    layers: list[int]
    flat: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    step: int = 0
    epoch: int = 0
    rows: list[tuple] = field(default_factory=list)
    best: np.ndarray | None = None

    def update(self, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean = BETA1 * self.mean + (1 - BETA1) * gradient
        self.square = BETA2 * self.square + (1 - BETA2) * gradient ** 2
        rate = RATE * np.sqrt(1 - BETA2 ** self.step) / (1 - BETA1 ** self.step)
        self.flat = self.flat - rate * self.mean / (np.sqrt(self.square) + EPSILON)


_ARRAYS = ("flat", "mean", "square", "best")


def save_state(spark: SparkSession, state: State, path: str) -> None:
    """K10 for training states: one row."""
    row = {"layers": state.layers, "step": state.step, "epoch": state.epoch, "rows": state.rows,
           **{a: None if getattr(state, a) is None else getattr(state, a).tobytes() for a in _ARRAYS}}
    ddl = "layers array<int>, step long, epoch int, rows array<struct<epoch: int, loss: double, val_loss: double, " \
          "epoch_time: double>>, " + ", ".join(f"{a} binary" for a in _ARRAYS)
    spark.createDataFrame([tuple(row[c.split()[0]] for c in
                                 ("layers", "step", "epoch", "rows", *_ARRAYS))], ddl).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> State:
    r = spark.read.parquet(path).first()
    arrays = {a: None if r[a] is None else np.frombuffer(bytes(r[a]), np.float64).copy() for a in _ARRAYS}
    return State(list(r["layers"]), step=r["step"], epoch=r["epoch"], rows=[tuple(x) for x in r["rows"]], **arrays)


def blocks(df: DataFrame, feature_cols: Sequence[str], id_col: str, label_col: str, n_batches: int,
           per_batch: int, seed: int) -> DataFrame:
    """``batch, n, x, y``: the rows dealt to batches, as blocks of bytes."""
    batch = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_batches)).cast("int")
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(per_batch)).cast("int")
    rows = df.select(batch.alias("batch"), part.alias("part"), F.col(id_col).alias("_id"),
                     F.col(label_col).cast("int").alias("_y"), *[F.col(c).cast("double") for c in feature_cols])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        x = pdf[list(feature_cols)].to_numpy(np.float64)
        return pd.DataFrame([(int(key[0]), len(pdf), x.tobytes(), pdf["_y"].to_numpy(np.int64).tobytes())],
                            columns=["batch", "n", "x", "y"])
    return rows.groupBy("batch", "part").applyInPandas(pack, "batch int, n int, x binary, y binary")


class Blocks:
    """The block table held by the executors, and where each batch lies."""

    def __init__(self, df: DataFrame, width: int):
        self.sc = df.sparkSession.sparkContext
        self.rdd = reliable_checkpoint(df).rdd.map(lambda r: (
            r["batch"], np.frombuffer(r["x"], np.float64).reshape(r["n"], width), np.frombuffer(r["y"], np.int64))) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        where = self.rdd.mapPartitionsWithIndex(lambda i, it: [(b, i, len(y)) for b, _, y in it]).collect()  # a row a block
        self.parts: dict[int, set[int]] = {}
        self.rows = 0
        for b, i, n in where:
            self.parts.setdefault(b, set()).add(i)
            self.rows += n

    def summed(self, fn, batch: int | None = None) -> list:
        """The results of ``fn(x, y)`` of the blocks of a batch (or of all)."""
        def run(it):
            return [fn(x, y) for b, x, y in it if batch is None or b == batch]
        parts = None if batch is None else sorted(self.parts.get(batch, ()))
        return self.sc.runJob(self.rdd, run, parts) if parts is None or parts else []

    def loss(self, flat, layers) -> float | None:
        """Mean log loss of all rows."""
        if not self.rows:
            return None
        return sum(self.summed(lambda x, y: summed_loss(flat, layers, x, y))) / self.rows

    def release(self) -> None:
        self.rdd.unpersist()


@dataclass
class Network:
    """A trained network; scores rows as the Spark ML models do."""
    layers: list[int]
    flat: np.ndarray

    def score(self, df: DataFrame, feature_cols: Sequence[str], name: str) -> DataFrame:
        layers, flat = self.layers, self.flat

        @F.pandas_udf("pred int, conf double")
        def apply(x: pd.Series) -> pd.DataFrame:
            p = probabilities(flat, layers, np.stack(x.to_numpy()).astype(np.float64))[0] if len(x) else np.zeros((0, 2))
            return pd.DataFrame({"pred": p.argmax(1).astype(np.int32), "conf": p.max(1)})
        out = df.withColumn("_m", apply(F.array(*[F.col(c).cast("double") for c in feature_cols])))
        return out.withColumns({f"pred_{name}": F.col("_m.pred"), f"conf_{name}": F.col("_m.conf")}).drop("_m")


def train_adam(train: DataFrame, val: DataFrame, feature_cols: Sequence[str], id_col: str, label_col: str = "y",
               hidden: Sequence[int] = (48, 24), classes: int = 2, batch: int = BATCH, epochs: int = EPOCHS,
               patience: int | None = None, seed: int = SEED, state: State | None = None,
               on_epoch=None) -> tuple[Network, State]:
    """Train for ``epochs`` epochs in all (``state``: resume from it).  With
    ``patience`` the run stops when the validation loss has not improved for
    that many epochs, and the network is that of the smallest one.  Rows hold
    (epoch, train loss, validation loss, seconds); ``on_epoch(state)`` is
    called after each epoch."""
    layers = [len(feature_cols), *hidden, classes]
    n = train.count()
    n_batches, per_batch = max(1, -(-n // batch)), max(1, -(-batch // BLOCK_ROWS))
    data = Blocks(blocks(train, feature_cols, id_col, label_col, n_batches, per_batch, seed), layers[0])
    held = Blocks(blocks(val, feature_cols, id_col, label_col, max(1, n_batches // 8), 1, seed), layers[0])
    if state is None:
        flat = initial(layers, seed)
        state = State(layers, flat, np.zeros_like(flat), np.zeros_like(flat))
    try:
        for epoch in range(state.epoch + 1, epochs + 1):
            t0 = time.time()
            for b in np.random.default_rng((seed, epoch)).permutation(n_batches).tolist():
                flat = state.flat
                found = data.summed(lambda x, y, w=flat: (len(y), *summed_gradient(w, layers, x, y)), b)
                rows = sum(f[0] for f in found)
                if rows:
                    state.update((sum(f[2] for f in found) + ALPHA * penalty(flat, layers)) / rows)
            loss, val_loss = data.loss(state.flat, layers), held.loss(state.flat, layers)
            past = [r[2] for r in state.rows if r[2] is not None]
            if val_loss is not None and (not past or val_loss < min(past)):
                state.best = state.flat.copy()
            state.rows.append((epoch, loss, val_loss, time.time() - t0))
            state.epoch = epoch
            if on_epoch:
                on_epoch(state)
            if patience and val_loss is not None and stale(state.rows) >= patience:
                break
    finally:
        data.release()
        held.release()
    best = state.best if patience and state.best is not None else state.flat
    return Network(layers, best), state


def stale(rows: Sequence[tuple]) -> int:
    """Epochs since the smallest validation loss."""
    losses = [r[2] for r in rows]
    return len(losses) - 1 - losses.index(min(losses))


def gradient_error(flat: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, checks: int = 60,
                   step: float = 1e-6) -> float:
    """Largest relative difference between the gradient and central finite
    differences, over some of its numbers."""
    _, g = summed_gradient(flat, layers, x, y)
    worst = 0.0
    for i in np.random.default_rng(1).choice(len(flat), min(checks, len(flat)), replace=False).tolist():
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        near = (summed_loss(up, layers, x, y) - summed_loss(down, layers, x, y)) / (2 * step)
        worst = max(worst, abs(near - g[i]) / max(1.0, abs(near), abs(g[i])))
    return worst
