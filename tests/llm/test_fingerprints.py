"""Operators 1 and 2 against brute force."""

import hashlib
import random
import re

from odd import documents, prose, texts
from pyspark.sql import functions as F

from flowlens.llm import order_minhash, preference

TURNS = "conv_id long, turn long, role string, text string, id long, key string, n long, t string"


def turns(spark, talks):
    return spark.createDataFrame([(c, n, r, x, 1, "k", 5, "t") for c, n, r, x in talks], TURNS)


def talk(conv, *parts):
    return [(conv, n, r, x) for n, (r, x) in enumerate(parts)]


def test_common_prefix_is_rendered_once(spark):
    data = talk(1, ("system", "s"), ("user", "q"), ("assistant", "good")) \
        + talk(2, ("system", "s"), ("user", "q"), ("assistant", "bad"), ("user", "why"), ("assistant", "so")) \
        + [(None, 0, "user", "lost")]
    (r,) = preference.preference_pairs(turns(spark, data)).collect()
    o, c = preference.OPEN, preference.CLOSE
    assert (r.chosen_id, r.rejected_id, r.prompt_turns) == (1, 2, 2)
    assert r.prompt == f"{o}system\ns{c}{o}user\nq{c}"
    assert r.chosen == f"{o}assistant\ngood{c}" and r.chosen_loss == f"good{c}"
    assert r.rejected == f"{o}assistant\nbad{c}{o}user\nwhy{c}{o}assistant\nso{c}"
    assert r.rejected_loss == f"bad{c}so{c}"


def test_odd_conversations(spark):
    long = [(9, i, "user" if i % 2 else "assistant", "w " * 50) for i in range(800)]
    data = talk(1, ("user", None), (None, "x")) + talk(2, ("user", None), (None, "x")) + talk(3, ("user", "")) \
        + long + [(4, None, "user", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    rows = preference.preference_pairs(turns(spark, data)).collect()
    assert sorted(x for r in rows for x in (r.chosen_id, r.rejected_id) if x) == [1, 2, 3, 4, 9]
    whole = {(r.chosen_id, r.rejected_id): r for r in rows}
    assert (1, 2) in whole and whole[1, 2].prompt_turns == 2 and whole[1, 2].chosen == whole[1, 2].rejected == ""
    single = [r for r in rows if r.rejected_id is None]
    assert len(single) == 1 and single[0].rejected == "" and single[0].prompt_turns == 0
    assert preference.preference_pairs(turns(spark, [])).count() == 0


def test_hot_first_turns_are_salted_and_match_the_oracle(spark, tmp):
    import sys
    import duckdb
    sys.path.insert(0, "tests")
    rng = random.Random(2)
    data = [row for c in range(300) for row in talk(c, ("user", "hi" if c % 3 else prose(c, 5)),
                                                    *[("assistant", rng.choice("xyz")), ("user", rng.choice("ab"))][:c % 3])]
    df = turns(spark, data)
    pairs = preference.pair_conversations(df, group=16).collect()
    ids = [x for p in pairs for x in (p.chosen_id, p.rejected_id) if x is not None]
    assert sorted(ids) == list(range(300))
    same = sum(p.rejected_id is not None and p.chosen[0].text == p.rejected[0].text for p in pairs)
    assert same >= 80  # of about 100 pairs of the hot first turn
    df.write.parquet(f"{tmp}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp}/c.parquet/*.parquet'")
    want = sorted(con.execute(preference.ORACLE).fetchall())
    assert sorted(tuple(r) for r in preference.preference_pairs(df).collect()) == want


def test_no_pair_of_one_first_turn_is_torn(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 3) for _ in range(200)]
    firsts = [f"question {k}" for k, n in enumerate(sizes) for _ in range(n)]
    rng.shuffle(firsts)
    data = [row for c, q in enumerate(firsts) for row in talk(c, ("user", q), ("assistant", f"answer {c}"))]
    pairs = preference.pair_conversations(turns(spark, data), group=64).collect()
    ids = [x for p in pairs for x in (p.chosen_id, p.rejected_id) if x is not None]
    assert sorted(ids) == list(range(len(firsts)))
    same = [firsts[p.chosen_id] for p in pairs if p.rejected_id is not None and firsts[p.chosen_id] == firsts[p.rejected_id]]
    assert sorted(same) == sorted(f"question {k}" for k, n in enumerate(sizes) for _ in range(n // 2))
    # those left over, one of each odd first turn, are paired too: at most one a bucket stands alone
    assert sum(p.rejected_id is None for p in pairs) <= -(-len(firsts) // 64)


def test_odd_groups_match_the_oracle_and_share_a_prompt(spark, tmp):
    """First turns of one to three conversations, some without an answer."""
    import duckdb
    rng = random.Random(12)
    data, c = [], 0
    for q in range(120):
        for _ in range(rng.randint(1, 3)):
            parts = [("user", f"question {q}")]
            for k in range(rng.randint(0, 3)):
                parts += [("assistant", f"answer {c}.{k}"), ("user", rng.choice(["why", "more", None]))]
            data += talk(c, *parts)
            c += 1
    df = turns(spark, data)
    got = preference.preference_pairs(df).collect()
    df.write.parquet(f"{tmp}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp}/c.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(preference.ORACLE).fetchall(), key=key)
    answered = {x for x, _, r, _ in data if r == "assistant"}
    for r in got:
        if r.rejected_id is not None and {r.chosen_id, r.rejected_id} <= answered:
            assert r.prompt_turns >= 1 and r.rejected_loss


def brute_sketches(spark, text):
    """Order MinHash of one text with plain loops; Spark only hashes."""
    w = re.split(r"\s+", text)
    if len(text) > order_minhash.LONG_WORDS * len(w):
        w = list(text)
    kmers = [w[i:i + order_minhash.K] for i in range(len(w))]
    df = spark.createDataFrame([(k[0], k[1] if len(k) > 1 else None) for k in kmers], "a string, b string")
    h = [r[0] for r in df.select(F.xxhash64("a", "b")).collect()]
    seen, pairs = {}, []
    for v in h:
        v >>= order_minhash.POSITION_BITS
        seen[v] = seen.get(v, -1) + 1
        pairs.append((v, seen[v]))
    two = spark.createDataFrame(pairs, "v long, n int").select(F.xxhash64("v", "n")).collect()
    buckets = {}
    for p, (x,) in enumerate(two):
        x >>= order_minhash.POSITION_BITS
        buckets.setdefault(x >> (38 - order_minhash.SKETCHES_BITS), []).append((x, p))
    out = set()
    for b, members in buckets.items():
        chosen = [x for _, x in sorted((p, x) for x, p in sorted(members)[:order_minhash.PER_SKETCH])]
        (r,) = spark.createDataFrame([(chosen,)], "c array<long>").select(F.xxhash64("c")).collect()
        out.add(((b % 64) << 32) | ((r[0] % 2**64) >> 32))
    return out


def test_fingerprint_equals_brute_force(spark):
    for text in ["", "one", "a b a b a b a", prose(4, 150), "the the the cat", "a\tb\u3000c\xa0d\n", "\u65e5\u672c\U0001f642" * 30,
                 "x" * 60]:
        df = spark.createDataFrame([(text,)], "t string")
        got = df.select(order_minhash.fingerprint(F.col("t")).alias("f")).first().f
        assert {x % 2**64 for x in got} == brute_sketches(spark, text), text


def edited(data):
    """Brute force of n_chars and the edited text; ids are unique."""
    order = sorted(data, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield i, len(t), t[:len(t) - half] + nxt[:half]


def test_edited_texts_across_blocks(spark):
    data = [(i * 700 + (i % 3), t) for i, t in texts().items()] + [(5 * 10**9, "far away text"), (-3000, "negative id here")]
    rows = {r.doc_id: r for r in order_minhash.fingerprints(documents(spark, data)).collect()}
    assert len(rows) == len(data)
    for i, n, e in edited(data):
        assert rows[i].n_chars == n
        assert rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), i
    by_text = {}
    for i, t in data:
        by_text.setdefault(t or "", set()).add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({*map(frozenset, by_text.values())}) == len(by_text)
    for r in rows.values():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[5 * 700 + 2].near_next == 1.0  # document 6 has the same text


def test_one_word_of_many_falls_little_whatever_the_spaces(spark):
    words = prose(21, 300).split()
    other = [*words[:150], "different", *words[151:]]
    rows = [(k, sep.join(a)) for k, sep in enumerate((" ", "\n", "\t", "\u3000", "")) for a in (words, other)]
    fp = [r.f for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i long, t string")
          .select("i", order_minhash.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]
    for k in range(0, len(fp), 2):
        a, b = set(fp[k]), set(fp[k + 1])
        assert a != b and len(a & b) / 64 > 0.8, rows[k][0]


def test_blocks_follow_documents_and_not_ids(spark):
    """Dense, hashed and clustered ids and a far outlier: blocks stay small."""
    r = random.Random(5)
    for ids in (list(range(40_000)), [r.randrange(-2**62, 2**62) for _ in range(40_000)],
                [*range(20_000), *range(10**12, 10**12 + 20_000), 10**18, -10**18]):
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        block = order_minhash.block_of(df)
        sizes = [x["n"] for x in df.groupBy(block(F.col("id")).alias("b")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 4 * order_minhash.BLOCK and len(sizes) < 700
        ends = {x["block"]: x["donor"] for x in order_minhash.block_ends(df, block).collect()}
        by = {}
        for x in df.distinct().select("id", block(F.col("id")).alias("b")).collect():
            by.setdefault(x["b"], []).append(x["id"])
        order = sorted(by)
        assert all(max(by[a]) < min(by[b]) for a, b in zip(order, order[1:]))
        assert ends == {a: min(by[b]) for a, b in zip(order, [*order[1:], order[0]])}


def test_odd_ids(spark):
    t = "some words of a text here"
    rows = order_minhash.fingerprints(documents(spark, [(None, t), (None, None), (1, t), (1, t), (2, "x y z")])).collect()
    assert len(rows) == 5
    for r in rows:
        if r.doc_id is None:
            assert r.near_next is None and r.edited_sha256 == hashlib.sha256(
                (t[:len(t) - len(t) // 2] if r.n_chars else "").encode()).hexdigest()
    assert sorted(r.near_next == 1.0 for r in rows if r.doc_id == 1) == [False, True]
    (only,) = order_minhash.fingerprints(documents(spark, [(7, t)])).collect()
    assert only.near_next == 1.0
    assert order_minhash.fingerprints(documents(spark, [])).count() == 0


def test_likeness_falls_with_order(spark):
    w = prose(11, 400).split(" ")
    moved = w[200:] + w[:200]
    shuffled = w[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:380] + w[385:]), " ".join(moved), " ".join(shuffled))],
                               "a string, b string, c string, d string")
    fp = {c: order_minhash.fingerprint(F.col(c)) for c in "abcd"}
    near = df.select(*[order_minhash.likeness(fp["a"], fp[c]).alias(c) for c in "abcd"]).first()
    assert near.a == 1.0 and near.b > 0.8 and near.b > near.c > near.d
