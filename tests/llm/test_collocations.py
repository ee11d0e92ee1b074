"""Operator 13 against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents, odd_documents, prose, texts

from flowlens.llm import collocations as C

DDL = "doc_id long, text string, lang string, a long, n string, key string, h1 string, chunk string"


def pieces(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows):
    f = defaultdict(Counter)
    for lang, text in rows:
        for w in pieces(text):
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i:i + k])] += 1
    return f


def brute(rows, min_count, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i:i + k]] = max(covered[p[i:i + k]], a)
        best = []
        for p, a in cand.items():
            if covered[p] < a:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, lf, r, n, -s) for i, (s, a, p, lf, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lang, 1, "n", "k", "h", "c") for i, (lang, t) in enumerate(rows)], DDL)
    return sorted(map(tuple, C.collocations(df, **kw).collect()))


def sample(seed, docs):
    r = random.Random(seed)
    line = " ".join(prose(seed + 1, 12).split())
    out = []
    for i in range(docs):
        words = " ".join(prose(r.randrange(6), r.randint(0, 120)).split(" "))
        text = r.choice([words, words.upper(), words + ". " + line, line + "\t" + words + "\x0b\x0c;;" + line])
        out.append((r.choice(["en", "en", "en", "de", None, ""]), text))
    return out


@pytest.mark.parametrize("min_count,top,bits", [(4, 2000, 28), (4, 15, 15), (2, 50, 15)])
def test_against_plain_counting(spark, min_count, top, bits):
    rows = sample(min_count, 90)
    assert run(spark, rows, min_count=min_count, top=top, max_bits=bits) == brute(rows, min_count, top)


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", "a a a a a a"), ("en", "A A a\ta,a  a"), ("de", "!!.,"), ("de", "é b É"),
            *[("x", "one two three four five six")] * 7]
    assert run(spark, rows, min_count=2) == brute(rows, 2, 2000)
    assert run(spark, [], min_count=2) == []
    assert run(spark, [("en", "a b")], min_count=2) == []
    odd = odd_documents(spark)
    expect = brute([(None, r["text"]) for r in odd.collect()], 3, 2000)
    assert sorted(map(tuple, C.collocations(odd, min_count=3).collect())) == expect
    assert C.collocations(documents(spark, [])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def grams_of(texts_):
    chunks = Counter(c for _, c in C.parse_all([t.encode() for t in texts_]))
    grams = C.Grams(b"x", list(chunks), np.array(list(chunks.values()), np.int64), 0)
    word = {int(h): w.decode("utf-8", "replace") for h, w in zip(grams.hash, grams.words)}
    found, hashes, n = grams.totals()
    got = Counter({(w.decode(),): int(v) for w, v in zip(found, n)})
    for k in range(2, 6):
        rows, total = grams.counted(k, 1, grams.passing(1, lambda h: np.ones(len(h), bool)))
        got.update({tuple(word[int(h)] for h in r): int(v) for r, v in zip(rows, total)})
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab cAB.\n\t\x0bé", max_size=120), min_size=1, max_size=6))
def test_chunks_hold_each_occurrence_once(texts_):
    assert grams_of(texts_) == counts([("x", t) for t in texts_])["x"]


def test_long_text_is_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 500)
    made = [t or "" for t in texts().values()]
    assert grams_of(made) == counts([("x", t) for t in made])["x"]


def test_equal_passages_share_chunks():
    passage = prose(9, 900)
    a, b = C.parse((prose(1, 300) + " " + passage).encode()), C.parse((prose(2, 313) + " " + passage).encode())
    assert len(set(a) & set(b)) > 0.5 * len(C.parse(passage.encode()))


def test_large_products_are_exact(spark):
    a, n, l, r = 12_345_678_901_234, 98_765_432_109_877, 23_456_789_012_345, 87_654_321_098_761
    df = spark.sql(f"select {a}L a, {n}L n, {l}L l, {r}L r")
    got = df.select(C.score_column().alias("s")).first()["s"]
    assert got == 1000 * a * n // (l * r)
