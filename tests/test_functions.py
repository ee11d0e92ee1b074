"""Column expressions: labels, IP parsing, votes, corner cases."""

import math

from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions import packets as PK
from flowlens.functions import votes as V
from flowlens.functions.numeric import round_half_away
from flowlens.operators import clean as C


def test_label_rules_disagree_on_padded_benign(spark):
    df = spark.createDataFrame([(" BENIGN ",), ("benign",), ("BENIGN",), ("DDoS",), (None,)], "l string")
    r = df.select(L.canonical_label(F.col("l")).alias("c"), L.binary_exact(F.col("l")).alias("e"),
                  L.binary_contains(F.col("l")).alias("s")).collect()
    assert [x["c"] for x in r] == ["ATTACK", "BENIGN", "BENIGN", "ATTACK", "ATTACK"]
    assert [x["e"] for x in r] == [1, 1, 0, 1, 1]
    assert [x["s"] for x in r] == [0, 0, 0, 1, 1]


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("inf"), 1, "a"), (float("-inf"), None, "b"), (float("nan"), 2, "c"),
                                (None, 3, "d"), (2.5, 4, "e")], "x double, n int, Label string")
    r = C.finite_or_zero(df).collect()
    assert [x["x"] for x in r] == [0.0, 0.0, 0.0, 0.0, 2.5]
    assert [x["n"] for x in r] == [1, 0, 2, 3, 4]


def test_last_octet_and_ipv4(spark):
    df = spark.createDataFrame([("10.0.0.7",), ("::1",), (None,), ("fe80::1:2",), ("1.2.3.x",)], "ip string")
    r = df.select(PK.last_octet("ip").alias("o"), PK.is_valid_ipv4("ip").alias("v")).collect()
    assert [x["o"] for x in r] == [7, 0, 0, 0, 0]
    assert [x["v"] for x in r] == [True, False, False, False, False]
    v = spark.createDataFrame([("256.1.1.1",), ("01.2.3.4",), ("255.255.255.255",)], "ip string")
    assert [x[0] for x in v.select(PK.is_valid_ipv4("ip")).collect()] == [False, False, True]


def test_plurality_ties_and_nulls(spark):
    df = spark.createDataFrame([([0, 1],), ([2, 1],), ([1, 1, 0],), ([None, 1],), ([None, None],)],
                               "p array<int>")
    cols = [F.col("p")[i] for i in range(2)]
    r = df.select(V.plurality_vote(cols).alias("v")).collect()
    assert [x["v"] for x in r] == [0, 1, 1, 1, None]


def test_majority_needs_more_than_half(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 0)], "a int, b int")
    r = df.select(V.majority_decision(["a", "b"]).alias("d")).collect()
    assert [x["d"] for x in r] == ["ACCEPT", "DROP", "ACCEPT"]
    assert df.select(V.majority_decision([]).alias("d")).first()["d"] == "ACCEPT"


def test_mean_ignoring_missing(spark):
    df = spark.createDataFrame([(0.5, None, 0.7), (None, None, None), (float("nan"), 0.4, None)],
                               "a double, b double, c double")
    r = [x[0] for x in df.select(V.mean_ignoring_nan(["a", "b", "c"])).collect()]
    assert math.isclose(r[0], 0.6) and r[1] is None and math.isclose(r[2], 0.4)


def test_round_half_away(spark):
    df = spark.createDataFrame([(0.5,), (-1.5,), (2.4,), (None,)], "x double")
    r = [x[0] for x in df.select(round_half_away("x", 0)).collect()]
    assert r == [1.0, -2.0, 2.0, None]


def test_canonical_ip_v4_v6(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("FE80:0:0:0:0:0:0:1",), ("::1",), ("01.2.3.4",), ("junk",), (None,)],
                               "ip string")
    got = {r["ip"]: r["ip_canonical"] for r in PK.canonical_ip(df, "ip").collect()}
    assert got == {"10.0.0.1": "10.0.0.1", "FE80:0:0:0:0:0:0:1": "fe80::1", "::1": "::1",
                   "01.2.3.4": None, "junk": None, None: None}


def test_canonical_ipv6_equals_the_address_parser(spark):
    import ipaddress
    import random
    r = random.Random(6)

    def parsed(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        if a.version == 4 or a.ipv4_mapped is None:
            return str(a)
        low = int(a) & 0xFFFFFFFF
        return f"::ffff:{low >> 16:x}:{low & 0xFFFF:x}"
    made = ["", ":", "::", ":::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":1::2",
            "1:2:3:4:5:6:7::8", "g::", "12345::", "::1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1.2.3.4", "01.2.3.4",
            "::1.2.3.4:5", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "0:0:0:0:0:0:0:0", "0:0:1:0:0:0:1:0", " ::1",
            "1:0:0:2:0:0:0:3", "0:0:1:1:0:0:1:1", "fe80::%1", "FE80::1%Eth0", "::%", "::%a%b", "%1", "::ffff:0:0", "1:0:2:0:3:0:4:0"]
    for _ in range(1500):
        groups = [r.choice(["0", "0", "0", "00", "0000", "1", "0a", "FfFf", "12", ""]) for _ in range(r.randint(1, 9))]
        text = ":".join(groups)
        if r.random() < 0.4:
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(["::", ":", "::"]) + text[at:]
        made.append(text)
    rows = [(t,) for t in made] + [(None,)]
    got = {x["ip"]: x["c"] for x in spark.createDataFrame(rows, "ip string").select(
        "ip", F.when(PK.is_valid_ipv4("ip"), F.col("ip")).otherwise(PK.canonical_ipv6("ip")).alias("c")).collect()}
    assert got[None] is None
    assert {t: got[t] for t in made} == {t: parsed(t) for t in made}
