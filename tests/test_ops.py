"""Scaler, sampling, metrics and rule operators against brute force."""

import math
import random

from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import rules as R
from flowlens.operators import sampling as SM
from flowlens.operators import scale as S


def test_scaler_constant_column_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    st = S.fit_scaler(df, ["a", "c"]).first()
    assert st["a__mean"] == 2.0 and st["a__std"] == 1.0 and st["c__std"] == 1.0
    out = S.apply_scaler(spark.createDataFrame([(3.0, 7.0)], "a double, c double"), S.fit_scaler(df, ["a", "c"]),
                         ["a", "c"]).first()
    assert out["a"] == 1.0 and out["c"] == 2.0  # constant column: divided by 1, not zeroed


def _hash_order(ids, seed):
    import hashlib
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))


def test_exact_sample_equals_global_rank(spark):
    ids = list(range(5000))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for n in (1, 37, 4999, 5000, 8000):
        got = sorted(r["id"] for r in SM.sample_exact_n(df, n, "id", 42).collect())
        assert got == sorted(_hash_order(ids, 42)[:n])


def test_stratified_quota_and_split(spark):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = SM.stratified_split(df, "y", "id", 0.2, 42)
    test = {r["id"] for r in out.where("split = 'test'").collect()}
    assert len(test) == math.ceil(0.2 * 1000)
    for cls in (0, 1):
        members = [i for i, y in rows if y == cls]
        q = sum(1 for i in members if i in test)
        assert q in (math.floor(0.2 * len(members)), math.ceil(0.2 * len(members)))
        assert {i for i in members if i in test} == set(_hash_order(members, 42)[:q])


def test_positional_split(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(101)], "id long")
    out = SM.split_positional(df, "id", 0.9)
    train = sorted(r["id"] for r in out.where("split = 'train'").collect())
    assert train == [i * 3 for i in range(90)]


def test_metrics_class_predicted_never_true(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "y int, p int")
    lp = M.long_predictions(df, "y", {"m": "p"})
    cc = M.confusion_counts(lp)
    pc = {r["label"]: r for r in M.per_class(cc).collect()}
    assert pc[2]["support"] == 0 and pc[2]["precision"] == 0.0 and pc[2]["f1"] == 0.0
    assert M.confusion_matrix(cc).count() == 9
    f1 = M.f1_weighted(cc).first()["f1_weighted"]
    assert math.isclose(f1, 0.5 * (2 / 3) + 0.5 * 0.5)  # class 0: F1 2/3, class 1: F1 1/2


def test_log_loss_zero_probability_is_inf(spark):
    df = spark.createDataFrame([("m", 0.0), ("m", 0.5)], "model string, p_true double")
    assert M.log_loss(df).first()["log_loss"] == float("inf")


def _rules(spark, rows):
    dec = spark.createDataFrame(rows, "rid long, ts long, src_ip string, ttl int").withColumn(
        "decision", F.lit("DROP"))
    return R.block_rules(dec, "ttl", id_col="rid", ts_col="ts")


def test_ttl_zero_permanent_and_unblock_keeps_permanent(spark):
    r = _rules(spark, [(1, 10, "a", 0), (2, 20, "a", 5), (3, 30, "b", 5)])
    got = {x["rule_id"]: x["expiry_us"] for x in r.collect()}
    assert got == {1: None, 2: 20 + 5_000_000, 3: 30 + 5_000_000}
    ub = spark.createDataFrame([("a", 25), ("a", 15), ("b", 29)], "src_ip string, unblock_us long")
    after = {x["rule_id"]: x["expiry_us"] for x in R.apply_unblocks(r, ub).collect()}
    assert after == {1: None, 2: 25, 3: 30 + 5_000_000}


def test_mark_blocked_against_brute_force(spark):
    rnd = random.Random(5)
    rules = [(i, rnd.randint(0, 10**10), rnd.choice("abc"), rnd.choice([0, 600, 3600, 20000])) for i in range(200)]
    flows = [(i, rnd.choice("abcd"), rnd.randint(0, 2 * 10**10)) for i in range(500)]
    r = _rules(spark, rules)
    f = spark.createDataFrame(flows, "fid long, src_ip string, start_us long")
    got = {x["fid"] for x in R.mark_blocked(f, r).where("blocked").collect()}

    def blocked(ip, t):
        for _, a, rip, ttl in rules:
            if rip == ip and a <= t and (ttl == 0 or t < a + ttl * 1_000_000):
                return True
        return False
    assert got == {fid for fid, ip, t in flows if blocked(ip, t)}
    assert R.mark_blocked(f, r).count() == len(flows)


def test_blocked_intervals_merge(spark):
    r = _rules(spark, [(1, 0, "a", 10), (2, 5_000_000, "a", 10), (3, 30_000_000, "a", 1), (4, 40_000_000, "a", 0)])
    iv = sorted((x["start_us"], x["end_us"]) for x in R.blocked_intervals(r).collect())
    assert iv == [(0, 15_000_000), (30_000_000, 31_000_000), (40_000_000, None)]


def test_blocked_intervals_random_small_buckets(spark):
    rnd = random.Random(11)
    rules = [(i, rnd.randint(0, 10**9), rnd.choice("ab"), rnd.choice([0, 1, 30, 120, 400])) for i in range(300)]
    r = _rules(spark, rules)
    got = sorted((x["src_ip"], x["start_us"], x["end_us"]) for x in R.blocked_intervals(r).collect())
    want = []
    for ip in "ab":
        iv = sorted((a, a + ttl * 1_000_000 if ttl else None) for _, a, rip, ttl in rules if rip == ip)
        cur = None
        for s, e in iv:
            if cur and (cur[1] is None or s <= cur[1]):
                cur[1] = None if (cur[1] is None or e is None) else max(cur[1], e)
            else:
                if cur:
                    want.append((ip, *cur))
                cur = [s, e]
        want.append((ip, *cur))
    assert got == sorted(want)


def test_first_n_exact(spark):
    ids = random.Random(3).sample(range(10**6), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "cid long")
    for n in (1, 250, 3000, 5000):
        got = sorted(r["cid"] for r in SM.first_n(df, "cid", n).collect())
        assert got == sorted(ids)[:n]


def test_both_classes_guard(spark):
    import pytest
    from flowlens.operators import clean as C
    one = spark.createDataFrame([("BENIGN",), ("benign",)], "label string")
    with pytest.raises(ValueError):
        C.require_both_classes(C.class_balance(one).first())
    two = spark.createDataFrame([("BENIGN",), ("DDoS",)], "label string")
    C.require_both_classes(C.class_balance(two).first())


def test_epoch_loop_early_stop(spark):
    from flowlens.operators import models as MD
    rnd = random.Random(2)
    rows = [(float(i % 2), rnd.random(), rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    _, log = MD.train_epochs(df.limit(160), df.limit(40), ["a", "b"], epochs=6, hidden=(3,), block=32, patience=1)
    assert 1 <= len(log) <= 6 and all(len(r) == 4 for r in log)


def test_model_refuses_other_layout(spark):
    import pytest
    from flowlens.operators import models as MD
    from flowlens.operators.cicids import flow_features_cicids
    from flowlens.operators.features import flow_features_78, packet_flows
    from flowlens.sources import fixtures as fx
    flows = packet_flows(fx.packets(spark, "/root/testdata/sf0.001"), 21600)
    f78 = flow_features_78(flows, keep=["close_id"]).withColumn("y", (F.col("close_id") % 2).cast("double"))
    cols = [f"f{i}" for i in range(78)]
    model = MD.make_pipeline(f78, cols, "lr").fit(f78)
    assert MD.score(model, f78, "lr").count() == f78.count()
    cic = flow_features_cicids(flows, keep=["close_id"])
    with pytest.raises(ValueError):
        MD.score(model, cic, "lr")


def test_nth_by_refinement(spark):
    """Clusters of ids, a far outlier and repeated values; tiny grids force
    several rounds, and no rest is ordered directly until it is small."""
    rnd = random.Random(8)
    rows = [(i * 2 if i < 900 else 10**15 + i, rnd.randrange(40)) for i in range(1000)] + [(-10**17, 3), (10**18, 4)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "k long, id long, v long")
    ids = sorted(r[0] for r in rows)
    pairs = sorted((r[1], k) for k, r in enumerate(rows))
    for n in (1, 2, 450, 901, 1001, 1002):
        for direct, grid in ((4, 8), (50_000, 1000)):
            assert SM.nth(df, ["id"], n, direct, grid) == (ids[n - 1],)
            assert SM.nth(df, ["v", "k"], n, direct, grid) == pairs[n - 1]
    assert SM.nth(df, ["id"], 1003) is None and SM.nth(df, ["id"], 0) is None
    assert sorted(r["id"] for r in SM.first_n(df, "id", 777, direct=4).collect()) == ids[:777]
    assert SM.first_n(df, "id", 5000).count() == 1002 and SM.first_n(df, "id", 0).count() == 0
    out = SM.split_positional(df, "id", 0.5, direct=4)
    assert sorted(r["id"] for r in out.where("split = 'train'").collect()) == ids[:501]
    assert SM.split_positional(df.limit(0), "id").count() == 0


def test_hash_cut_with_narrow_brackets(spark):
    """Brackets that miss the cut grow until they hold it; null classes and
    quotas of nothing or everything are exact, too."""
    rows = [(i, None if i % 5 == 0 else i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int")
    want = {None: 40, 0: 0, 1: 10**6, 2: 1}
    table = spark.createDataFrame(list(want.items()), "y int, n long")
    got = {}
    for r in SM.hash_cut(df, "id", 42, lambda counts: table, "y", spread=0.01).where("_in").collect():
        got.setdefault(r["y"], set()).add(r["id"])
    for y, n in want.items():
        members = [i for i, c in rows if c == y]
        assert got.get(y, set()) == set(_hash_order(members, 42)[:n])
