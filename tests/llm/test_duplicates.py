"""Operators 7 and 8 against brute force, and the pipeline."""

import random
import re

import numpy as np
import pytest
from odd import documents, odd_documents, prose, texts

from flowlens.llm import graph, latent, near_dedup
from flowlens.llm import setsketch as ss

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] * bool(w)))


def brute(data):
    """doc -> component, by all pairs."""
    sets = [(i, shingles(t)) for i, t in data]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= 80 * (len(a) + len(b) - n):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i, _ in sets}


def corpus():
    """Copies, a chain of near copies, and a large group just around 0.8."""
    rng = random.Random(7)
    data, n = list(texts().items()), 100
    for g in range(12):
        words = prose(50 + g, rng.randint(6, 150)).split(" ")
        for _ in range(rng.randint(1, 8)):
            data.append((n, " ".join(words)))
            n += 1
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"q{rng.randint(0, 99)}"
    base = prose(99, 120).split(" ")
    for _ in range(60):
        w = base[:]
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9999)}"
        data.append((n, " ".join(w)))
        n += 1
    rng.shuffle(data)
    return data


def test_components_equal_brute_force(spark):
    data = corpus()
    rows = near_dedup.near_duplicates(documents(spark, data)).collect()
    want = brute(data)
    assert len(rows) == len(data) and len(set(want.values())) < len(data) - 50
    for r in rows:
        assert r.n_shingles == len(shingles(dict(data)[r.doc_id]))
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.keep_one(documents(spark, data))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == by[7].component_id == by[15].component_id == 5 and not by[6].kept
    assert all(by[i].component_id == i and by[i].kept and by[i].n_shingles == 0 for i in (0, 1, 11))
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = near_dedup.keep_one(docs).collect()
    assert [r.doc_id for r in kept].count(5) == 1 and [r.doc_id for r in kept].count(None) == 2
    empty = documents(spark, [])
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("most", [0, 40, None])
def test_components_of_chains(spark, most):
    """A long chain, a star, small groups; with and without rounds of stars."""
    ends = list(range(200))
    random.Random(1).shuffle(ends)
    star = [(700, 701 + i) for i in range(60)]
    links = spark.createDataFrame([*zip(ends, ends[1:]), *star, (500, 501), (501, 502), (600, 600), (9, -4)],
                                  "a long, b long")
    got = {r.id: r.component for r in graph.components(links, most).collect()}
    assert all(got[i] == -4 for i in ends) and got[502] == 500 and all(got[i] == 700 for _, i in star)
    assert got.get(600, 600) == 600 and len(got) >= 200 + 61 + 3 + 1
    assert graph.components(links.limit(0), most).count() == 0


def test_texts_that_share_an_id(spark):
    """Each of two texts under one id keeps its own links."""
    a, b = prose(31, 60), prose(32, 60)
    rows = near_dedup.near_duplicates(documents(spark, [(5, a), (5, b), (2, a + " z"), (3, b + " y"), (9, prose(33, 60))])) \
        .collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(2, 2), (3, 3), (5, 2), (5, 3), (9, 9)]


def test_registers_estimate_the_likeness():
    rng = np.random.default_rng(0)
    every = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (0, 300, 1000, 1600, 2000):
        a, b = np.unique(every[:2000]), np.unique(np.r_[every[:shared], every[2000:2000 + 1000 - min(1000, shared // 2)]])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        k = ss.registers([a, b])
        got, possible = ss.may_reach(0.8, k[:1], k[1:], np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - j) < 0.12 and (possible[0] or j < 0.8)
        # registers of a union are the larger ones of its parts
        assert (ss.registers([np.union1d(a, b)])[0] == np.maximum(k[0], k[1])).all()


def test_bands_miss_nothing_at_the_limit():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        x = rng.integers(0, 2**63, 220).astype(np.uint64)
        a, b = np.unique(x[:200]), np.unique(np.r_[x[:178], x[200:222]])
        keys = ss.bands(ss.registers([a, b]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "item_id long, text string, words string, n long")


def leak_corpus():
    rng, items = random.Random(3), [(i, prose(7000 + i, 14 + i)) for i in range(30)]
    docs, truth = [], set()
    for d in range(400):
        words = prose(d, rng.randint(1, 300)).split(" ")
        if d % 10 == 0:
            i, t = items[rng.randrange(30)]
            at = rng.randrange(len(words) + 1)
            w = t.upper().split() if d % 20 else t.split()
            if d % 30 == 0:  # a paraphrase: a few words differ, the answer stands
                for _ in range(len(w) // 8):
                    w[rng.randrange(len(w) - 6)] = "changed"
            words[at:at] = w
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, truth


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, truth = leak_corpus()
    df = documents(spark, [*docs, (None, items[3][1]), (1000, None), (1001, "")])
    rows = latent.leaks(df, bench(spark, [*items, (90, None), (91, "")])).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth | {(None, 3)}
    kept = latent.keep_clean(df, bench(spark, items))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in truth} | {1000, 1001}


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    docs, items, truth = leak_corpus()
    df = documents(spark, docs[:120])
    monkeypatch.setattr(latent, "BLOCK_ITEMS", 12)
    got = latent.leaks(df, bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {x for x in truth if x[0] < 120}
    assert latent.leaks(df, bench(spark, [])).count() == 0
    assert latent.keep_clean(df, bench(spark, [])).count() == 120
    assert latent.leaks(documents(spark, []), bench(spark, items)).count() == 0
    assert latent.leaks(odd_documents(spark), bench(spark, [(1, None), (2, texts()[12])])).count() == 2


def accepted(text, item):
    """The rule on every passage of a text, with a plain table."""
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]
    words, item = text.lower().split(), item.lower().split()
    w = latent.window_of(len(item))
    for start in range(0, max(1, len(words) - w + w // 4), w // 4):
        around = words[max(0, start - w // 2):min(start + w, len(words)) + w // 2]
        answer = any(around[i:i + 5] == item[-5:] for i in range(len(around) - 4))
        if lcs(item, around) / len(item) >= (0.6 if answer else 0.8):
            return True
    return False


def test_every_leak_of_the_rule_is_found(spark):
    rng = random.Random(5)
    # items of words of their own beside common ones, in unknown and in well-known surroundings
    items = [(i, " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
                          for _ in range(15 + 4 * i))) for i in range(10)]
    docs = []
    for i, t in items:
        for kind in range(6):
            w = t.split()
            if kind < 2:  # a paraphrase that keeps the answer
                for p in rng.sample(range(len(w) - 5), min(len(w) - 5, len(w) * (4 + kind) // 10)):
                    w[p] = "changed"
            elif kind < 4:
                for p in rng.sample(range(len(w)), len(w) * kind // 12):
                    w[p] = "changed"
            else:
                w = [y for x in w for y in ([x, "between"] if rng.random() < 0.6 else [x])]
            body = [f"w{rng.randrange(400)}" if kind % 2 else f"o{rng.randrange(10**6)}" for _ in range(120)]
            at = rng.randrange(121)
            docs.append((len(docs), " ".join(body[:at] + w + body[at:])))
    want = {(d, i) for d, t in docs for i, x in items if accepted(t, x)}
    assert len(want) > 40
    got = latent.leaks(documents(spark, docs), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_lcs_equals_the_table():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 40))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent.lcs_length(a, b) == t[-1][-1]


def test_randomised_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(6)
    rows = [rng.choice(60, 12, p=np.r_[np.full(10, 0.06), np.full(50, 0.008)]).tolist() for _ in range(300)]
    idf = rng.uniform(1, 3, 60)
    a = np.zeros((300, 60))
    for i, r in enumerate(rows):
        for w in r:
            a[i, w] += idf[w]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    df = spark.createDataFrame([(r,) for r in rows], "words array<int>").repartition(4)
    v = latent.randomised_svd(df, idf, 8)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)
    assert np.linalg.norm(a @ v) ** 2 > 0.98 * (s[:8] ** 2).sum()


def test_products_from_passages_equal_those_of_the_gram_matrix(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 70, n).tolist() for n in rng.integers(0, 40, 700)]
    idf = rng.uniform(1, 3, 70)
    df = spark.createDataFrame([(r,) for r in rows], "words array<int>").repartition(3)
    a = latent.randomised_svd(df, idf, 5)
    monkeypatch.setattr(latent, "GRAM_WORDS", 0)
    b = latent.randomised_svd(df, idf, 5)
    assert np.allclose(a, b, atol=1e-8)


def latent_corpus():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(20)]
    items = [(i, " ".join(words[i * 4:i * 4 + 8])) for i in range(4)]
    weights = [20 - i for i in range(20)]
    docs = [(d if d % 7 else None, " ".join(rng.choices(words + ["other"], weights + [9], k=rng.randint(0, 90))))
            for d in range(2500)]
    return docs, items


def leading(docs, items, model, rank):
    """The space of every passage and item, by a plain eigendecomposition."""
    place = {int(h): i for i, h in enumerate(model.vocabulary.hashes)}
    passages = [t.split()[k:k + 32] for _, t in docs for k in range(0, len(t.split()), 32)] + [t.split() for _, t in items]
    known = {w: place[int(latent.words_of([w])[0][0])] for _, t in items for w in t.split()}
    a = np.zeros((len(passages), len(place)))
    for x, p in zip(a, passages):
        for w in p:
            if w in known:
                x[known[w]] += model.idf[known[w]]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    return np.linalg.eigh(a.T @ a)[1][:, -rank:]


@pytest.mark.parametrize("gram_words", [5000, 0])
def test_the_latent_space_is_of_all_documents(spark, monkeypatch, gram_words):
    monkeypatch.setattr(latent, "GRAM_WORDS", gram_words)
    docs, items = latent_corpus()
    model = latent.fit(documents(spark, docs), items, rank=6)
    want = leading(docs, items, model, 6)
    assert np.allclose(np.linalg.svd(want.T @ model.space, compute_uv=False), 1, atol=1e-6)
