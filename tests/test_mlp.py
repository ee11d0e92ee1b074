"""The relu network and Adam: gradients, steps, early stop, resuming."""

import os

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import mlp as M


def table(spark, n=600, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(int)
    return spark.createDataFrame([(i, *map(float, v), float(k)) for i, (v, k) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, d double, y double"), x, y


def test_gradient_equals_finite_differences():
    r = np.random.default_rng(3)
    layers = [5, 7, 4, 3]
    x, y = r.normal(size=(50, 5)), r.integers(0, 3, 50)
    assert M.gradient_error(M.initial(layers, 1), layers, x, y, checks=200) < 1e-5


def test_steps_equal_a_plain_loop(spark):
    """The distributed steps are those of one process over the same batches."""
    df, x, y = table(spark)
    layers = [4, 8, 2]
    _, state = M.train_adam(df, df.limit(0), ["a", "b", "c", "d"], "id", hidden=(8,), batch=100, epochs=3)
    of = {r["id"]: r["b"] for r in df.select("id", F.pmod(F.xxhash64("id", F.lit(M.SEED)), F.lit(6)).alias("b")).collect()}
    w = M.initial(layers)
    plain = M.State(layers, w, np.zeros_like(w), np.zeros_like(w))
    for epoch in (1, 2, 3):
        for b in np.random.default_rng((M.SEED, epoch)).permutation(6).tolist():
            at = [i for i in range(600) if of[i] == b]
            _, g = M.summed_gradient(plain.flat, layers, x[at], y[at])
            plain.update((g + M.ALPHA * M.penalty(plain.flat, layers)) / len(at))
    assert np.allclose(plain.flat, state.flat, rtol=0, atol=1e-10) and state.step == 18
    assert [r[2] for r in state.rows] == [None] * 3          # no validation rows


def test_early_stop_resume_and_score(spark, tmp):
    df, x, y = table(spark)
    train, val = df.where("id < 450"), df.where("id >= 450")
    path = os.path.join(tmp, "state")

    def keep(state):
        if state.epoch == 2:
            M.save_state(spark, state, path)
    net, state = M.train_adam(train, val, ["a", "b", "c", "d"], "id", hidden=(16, 8), batch=64, epochs=40, patience=2,
                              on_epoch=keep)
    losses = [r[2] for r in state.rows]
    assert len(losses) == 40 or M.stale(state.rows) == 2
    assert abs(M.summed_loss(net.flat, net.layers, x[450:], y[450:]) / 150 - min(losses)) < 1e-9
    again, _ = M.train_adam(train, val, ["a", "b", "c", "d"], "id", hidden=(16, 8), batch=64, epochs=40, patience=2,
                            state=M.load_state(spark, path))
    assert np.allclose(again.flat, net.flat, rtol=0, atol=1e-9)
    got = net.score(val, ["a", "b", "c", "d"], "m").orderBy("id").select("pred_m", "conf_m").toPandas()
    p = M.probabilities(net.flat, net.layers, x[450:])[0]
    assert (got["pred_m"].to_numpy() == p.argmax(1)).all() and np.allclose(got["conf_m"], p.max(1))
