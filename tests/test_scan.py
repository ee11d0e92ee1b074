"""Running values, as-of lookups and block intervals against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import rules as R
from flowlens.operators import scan


def events(seed, n):
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "hot", "a", None]), r.randrange(n // 4), r.choice([None, r.randint(-50, 50)]))
            for i in range(n)]


@pytest.mark.parametrize("own", [False, True])
def test_running_values(spark, own):
    rows = events(1, 400)
    df = spark.createDataFrame(rows, "id long, g string, t long, v long")
    parts = scan.ordered_parts(df, ["g"], ["t", "id"], parts=7)
    assert parts.where("g = 'hot'").select(scan.PART).distinct().count() > 3   # one group, many tasks
    got = {r["id"]: (r["top"], r["total"], r["late"]) for r in scan.running(
        parts, ["g"], ["t", "id"], {"top": ("max", "v"), "total": ("sum", "v"), "late": ("last", "v")}, own).collect()}
    for g in ("hot", "a", None):
        seen = []
        for i, _, t, v in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0])):
            if own and v is not None:
                seen.append(v)
            assert got[i] == ((max(seen), sum(seen), seen[-1]) if seen else (None, None, None))
            if not own and v is not None:
                seen.append(v)


def test_as_of(spark):
    r = random.Random(2)
    left = events(3, 300)
    starts = sorted({(g, r.randrange(80)) for g in ("hot", "a", None) for _ in range(25)}, key=str)
    right = [(g, s, n) for n, (g, s) in enumerate(starts)]
    got = scan.as_of(spark.createDataFrame(left, "id long, g string, t long, v long"),
                     spark.createDataFrame(right, "g string, s long, n long"), ["g"], "t", "s")
    assert got.columns == ["id", "g", "t", "v", "found"]
    for x in got.collect():
        before = [(s, n) for g, s, n in right if g == x["g"] and s <= x["t"]]
        assert (tuple(x["found"]) if x["found"] else None) == (max(before) if before else None)


def rule_table(spark, rows):
    d = spark.createDataFrame([(i, a, s, e) for i, (a, s, e) in enumerate(rows)],
                              "rule_id long, src_ip string, added_at_us long, expiry_us long")
    return d


def test_intervals_and_lookups(spark):
    r = random.Random(5)
    year = 365 * 86400 * 10**6
    rows = [("hot", (s := r.randrange(60_000_000)), s + r.choice([1, 100_000, 3_000_000])) for _ in range(500)]
    rows += [("long", 0, 10 * year), ("ever", 5, None), ("ever", 1, 3), (None, 1, 9), ("touch", 1, 5), ("touch", 5, 9)]
    rules = rule_table(spark, rows)
    got = {}
    for x in R.blocked_intervals(rules).collect():
        got.setdefault(x["src_ip"], []).append((x["start_us"], x["end_us"], x["n_rules"]))
    assert got["touch"] == [(1, 9, 2)] and got["long"] == [(0, 10 * year, 1)]
    assert sorted(got["ever"]) == [(1, 3, 1), (5, None, 1)]
    merged = []
    for _, s, e in sorted(x for x in rows if x[0] == "hot"):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
            merged[-1][2] += 1
        else:
            merged.append([s, e, 1])
    assert sorted(got["hot"]) == [tuple(m) for m in merged]
    flows = [(i, r.choice(["hot", "long", "ever", "none", None]), r.choice([None, r.randrange(65_000_000), r.randrange(8)]))
             for i in range(400)]
    marked = R.mark_blocked(spark.createDataFrame(flows, "id long, src_ip string, start_us long"), rules).collect()
    assert len(marked) == len(flows)
    for x in marked:
        t = x["start_us"]
        assert x["blocked"] == any(a is not None and a == x["src_ip"] and t is not None and s <= t and (e is None or t < e)
                                   for a, s, e in rows)


def test_lookups_do_not_multiply_rows(spark):
    """A rule of ten years and many rules within a minute: one event a rule."""
    year = 365 * 86400 * 10**6
    many = spark.range(20_000).select(
        F.col("id").alias("rule_id"), F.when(F.col("id") == 0, "long").otherwise("hot").alias("src_ip"),
        (F.col("id") * 3000).alias("added_at_us"),
        F.when(F.col("id") == 0, 10 * year).otherwise(F.col("id") * 3000 + 1000).alias("expiry_us"))
    flows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "long").otherwise("hot").alias("src_ip"),
                                     (F.col("id") * 30_000 + 500).alias("start_us"))
    got = {r["src_ip"]: r["n"] for r in R.mark_blocked(flows, many).where("blocked").groupBy("src_ip")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {"long": 1000, "hot": 1000}
