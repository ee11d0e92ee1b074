"""Operator 11 against plain integer rounds."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from flowlens.llm import vector_codes as V

DDL = "vec_id long, embedding array<float>, label int, x long, uid long, part int, code string, error long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, "c", 4, "i") for i, v, lab in rows], DDL)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    edge = [i * dims // parts for i in range(parts + 1)]
    cut = [[v[a:b] for _, v, _ in kept] for a, b in zip(edge, edge[1:])]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(books[p])) for x in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x, (_, n) in zip(cut[p], assign(p)):
                groups[n].append(x)
            for n, xs in groups.items():
                books[p][n] = [sum(c) // len(xs) for c in zip(*xs)]
    last = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{last[p][k][1]:02x}" for p in range(parts)), sum(last[p][k][0] for p in range(parts)), r[2])
           for k, r in enumerate(kept)]
    by = defaultdict(int)
    for _, _, e, lab in out:
        by[lab] += e
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(by[lab]), digest) for i, c, e, lab in out), key=str)


def got(spark, rows, **kw):
    return sorted(map(tuple, V.compress(frame(spark, rows), **kw).collect()), key=str)


def single(v):
    return [float(np.float32(x)) for x in v]


def clustered(seed, n, dims=16, spread=0.02):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(12)]
    return [(i, single([c + r.gauss(0, spread) for c in r.choice(centres)]), r.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("dims,block", [(16, 4), (16, 256), (20, 8)])
def test_against_plain_rounds(spark, dims, block):
    rows = clustered(dims, 300, dims)
    assert got(spark, rows, block=block) == brute(rows)


def test_ties_and_copies(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.25, -0.25]) for _ in range(8)], 7) for i in range(150)]
    rows += [(500 + i, [0.25] * 8, None) for i in range(150)]
    assert got(spark, rows, block=16) == brute(rows)


def test_odd_rows(spark):
    v = [0.5] * 8
    rows = [(1, None, 1), (2, [None] + v[1:], 1), (3, [float("nan")] + v[1:], 1), (4, [float("inf")] + v[1:], 2),
            (5, v, 2), (5, v, 2), (6, [-0.0001] + v[1:], None), (None, [0.1] + v[1:], None), (7, v[:4], 3), (8, [], 3)]
    rows = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], lab) for i, x, lab in rows]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == []
    assert got(spark, [(1, [], 1)]) == brute([(1, [], 1)])


def test_large_components_stay_exact(spark):
    r = random.Random(4)
    rows = [(i, single([r.uniform(-1, 1) * 10 ** r.choice([0, 5, 8]) for _ in range(8)]), i % 2) for i in range(60)]
    assert got(spark, rows, block=4) == brute(rows)


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = np.indices([1 << bits] * dims).reshape(dims, -1).T
        key = V.hilbert(side, bits)
        assert sorted(key.tolist()) == list(range(len(side)))
        walk = side[np.argsort(key)]
        assert (abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_the_nearest_and_leave_others_out():
    r = np.random.default_rng(1)
    book = r.integers(-4000, 4000, (16, 4))
    short_ones = 0
    for _ in range(300):
        x = r.integers(-4000, 4000, 4) + r.integers(-150, 150, (20, 4))
        short = V.shortlists(x.min(0)[None], x.max(0)[None], book)[0]
        entry, dist = V.nearest(x, book, np.arange(16))
        assert short[entry].all()
        again, same = V.nearest(x, book, np.flatnonzero(short))
        assert (entry == again).all() and (dist == same).all()
        short_ones += short.sum() < 16
    assert short_ones > 250
