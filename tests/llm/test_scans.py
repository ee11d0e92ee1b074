"""Operators 9, 10 and 5 against brute force, exact texts and held-out rows."""

import random
import re

import numpy as np
from odd import documents, odd_documents, prose, texts

from flowlens.llm import crf, html_text, licenses, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    hits = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(w))
                  if w[i:i + len(p.split())] == p.split())
    return (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None,
            ",".join(sorted({x for _, x in hits})))


def test_license_base_equals_brute_force(spark):
    t = texts()
    extra = {100: "Licensed under the Apache License, Version 2.0.\nMIT-License cc by cc by GNU General  Public\nLicense!",
             101: "éCC BY cc\x00by CC-BY 4.0 mit licensed", 102: "mit license " * 500,
             103: "ccby apachelicense gnu general publicx license"}
    rows = licenses.scan_licenses(documents(spark, [*t.items(), *extra.items()])).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute({**t, **extra}[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) >= bool(r.n_base)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_shunting_yard():
    ev = licenses.evaluate
    post = licenses.to_postfix
    assert post("a or b and c".split()) == ["a", "b", "c", "and", "or"]
    assert post("( a or b ) and c with d".split()) == ["a", "b", "or", "c", "d", "with", "and"]
    for bad in ("a or", "or a", "( a", "a )", "a b", ""):
        assert post(bad.split()) is None
    every, bound, form = ev(post("( mit or gpl-2.0 ) and bsd-3-clause".split()))
    assert every == {"mit", "gpl", "bsd"} and bound == {"bsd"} and form == "(gpl OR mit) AND bsd"
    assert ev(post("gpl-2.0 or mit or gpl-3.0".split()))[1:] == (frozenset(), "gpl OR mit")
    assert ev(post("mit and mit".split())) == ({"mit"}, {"mit"}, "mit")
    assert ev(post("( mit or isc ) with x-exception".split()))[2] == "(isc OR mit) WITH x-exception"
    for text, binding, forms in (("MIT OR GPL-2.0", "", "gpl OR mit"), ("MIT AND GPL-2.0", "gpl,mit", "gpl AND mit"),
                                 ("(MIT OR ISC) AND (ISC OR MIT)", "", "(isc OR mit)"),
                                 ("GPL-2.0 WITH classpath AND MIT", "gpl,mit", "gpl WITH classpath AND mit")):
        got = licenses.scan(f"// SPDX-License-Identifier: {text}\n")
        assert got[7] == binding and got[8].strip("()") == forms.strip("()"), got
    two = licenses.scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC OR MPL-2.0\n")
    assert two[7:] == ("mit", "isc OR mpl; mit")
    n = licenses.scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1-only WITH x-exception */\nnext")
    assert n[5] == "apache,lgpl,mit" and n[6] > 0.9
    assert licenses.scan("SPDX-License-Identifier:")[5:] == ("", 0.0, "", "")
    assert licenses.scan("spdx-license-identifier: mit and")[5] == "mit"


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><article>";</script></head>
<body class="page"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home page</a></li></ul></nav><!-- ad <p> -->
<div class="ad">Buy now this and that thing</div><article><h1>Title &lt;one&gt;</h1><p>First <b>bold</b>
 text&nbsp;here <a href="/x">and a link</a>, 1 < 2.<p>Second<br>line &copy; &#233;</p>
<aside>related things to read</aside><ul><li>item one of list</li><li>item two of list</li></ul></article>
<section class="comments"><p>Nice post by a reader with many words</p></section><form><p>Send us words</p></form>
<footer>&copy; all of the rights</footer>"""
WANT = ("Title <one>\n\nFirst bold text here and a link, 1 < 2.\n\nSecond line © é\n\nitem one of list\n\n"
        "item two of list")


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "clash", None) for i, h in rows],
                                 "page_id long, url string, html string, text string, key string")


def test_html_article_text(spark):
    rows = [(i, ARTICLE) for i in range(20)] + [(90, None), (91, ""), (92, "plain words"), (93, "<p>cut off <b>wor"),
            (94, "<nav><a href=x>menu</a></nav>"), (None, ARTICLE), (95, ARTICLE), (95, ARTICLE),
            (96, "<article>" + "<p>many words in a paragraph</p>" * 3000 + "</article>")]
    got = html_text.extract_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is None or r.page_id < 20 or r.page_id == 95:
            assert r.text == WANT
    by = {r.page_id: r.text for r in got}
    assert (by[90], by[91], by[94]) == ("", "", "")
    assert by[92] == "plain words" and by[93] == "cut off wor"
    assert by[96] == "\n\n".join(["many words in a paragraph"] * 3000)
    assert html_text.extract_pages(pages(spark, [])).count() == 0
    assert html_text.extract(ARTICLE, {}) == WANT  # the default weights


def test_best_region_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best


def loop_marginals(e, lengths, trans):
    out, at, t = [], 0, np.exp(trans)
    for n in lengths:
        a, v = [], np.array([1.0, 0.0])
        for x in e[at:at + n]:
            v = v @ (t * [1, np.exp(x)])
            v = v / v.sum()
            a.append(v)
        b, p = np.ones(2), [0.0] * n
        for i in range(n - 1, -1, -1):
            q = a[i] * b
            p[i] = q[1] / q.sum()
            b = (t * [1, np.exp(e[at + i])]) @ b
            b = b / b.sum()
        out += p
        at += n
    return np.array(out)


def test_marginals_equal_the_loop():
    rng = np.random.default_rng(4)
    lengths = np.array([0, 1, 31, 32, 33, 200, 5, 0, 64])
    e, trans = rng.normal(0, 3, lengths.sum()), rng.normal(0, 2, (2, 2))
    assert np.abs(crf.marginals(e, lengths, trans) - loop_marginals(e, lengths, trans)).max() < 1e-12
    assert crf.marginals(np.zeros(0), np.zeros(3, int), trans).size == 0


def test_gradient_by_runs_equals_that_by_tokens():
    rng = np.random.default_rng(7)
    lengths, labels, copies = np.array([0, 1, 3, 33, 200, 1000, 40]), [1, 1, 0, 1, 0, 1, 1], [1, 2, 1, 3, 1, 1, 0.5]
    places = [[], [0], [], [0, 1, 2, 32], [5, 90, 199], sorted(rng.choice(1000, 70, replace=False).tolist()), [*range(40)]]
    features = [[rng.choice(6, rng.integers(1, 4), replace=False).tolist() for _ in at] for at in places]
    theta = rng.normal(0, 1, 10)
    trans = np.array([[0, theta[7]], [theta[8], theta[9]]])
    want = np.zeros(10)
    for n, label, weight, at, found in zip(lengths, labels, copies, places, features):
        e, y = np.full(n, theta[6]), np.zeros(n, int)
        for i, f in zip(at, found):
            e[i] += theta[f].sum()
            y[i] = label
        p, a, b, x = crf.forward_backward(e, np.array([n]), trans)
        t = np.exp(trans)
        pair = np.array([a[0] * t[0, 0] * b[0], a[0] * t[0, 1] * x * b[1], a[1] * t[1, 0] * b[0], a[1] * t[1, 1] * x * b[1]])
        seen = np.bincount(2 * np.r_[0, y][:n] + y, minlength=4)
        for i, f in zip(at, found):
            want[f] += weight * (y[i] - p[i])
        want[6] += weight * (y - p).sum()
        want[7:] += weight * (seen - (pair / pair.sum(0)).sum(1))[1:]
    block = crf.block(lengths.tolist(), labels, copies, places, features)
    assert np.allclose(crf.gradient(block, theta), want, rtol=1e-9, atol=1e-9)


def toxic_corpus():
    rng, rows, labels = random.Random(9), [], []
    for i in range(600):
        words, toxic = prose(1000 + i, rng.randint(5, 80)).split(" "), i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zonkig", "zonkei", "Vlurb", "vlurbs,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    docs = documents(spark, [*rows, (None, rows[0][1]), (700, None), (701, ""), (702, "vlurb " * 20_000)])
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    truth, held = dict(labels), 0
    assert len(got) == len(rows) + 4
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id in truth:
            held += r.held_out
            assert r.predicted == truth[r.doc_id], r
            text = rows[r.doc_id][1]
            assert bool(r.spans) == bool(truth[r.doc_id])
            for s in r.spans:
                assert re.search("zonk|vlurb", text[s.start:s.end].lower())
    assert 80 < held < 220
    by = {r.doc_id: r for r in got}
    assert by[700].score == by[701].score < 0.3 and by[702].predicted == 1
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in labels if not t} | {700, 701}
    # nothing to learn from
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    none = toxicity.fit(docs, empty)
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(documents(spark, []), none).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = toxic_corpus()
    docs = documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    import zlib
    assert held == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    wrong = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, lab), toxicity.fit(docs, wrong)
    assert a.weight == b.weight and (a.logit == b.logit).all()


def test_odd_documents_score(spark):
    docs = odd_documents(spark)
    lab = spark.createDataFrame([(5, 1), (12, 0), (14, 0), (6, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, lab)).count() == docs.count()


def test_a_hinted_wrapper_does_not_cover_the_article():
    page = "<body><div class='layout has-sidebar'><div>menu words</div><article><p>{}</p>" \
           "<div class='share'>send it</div></article></div>{}</body>"
    text = "The text of the article"
    assert html_text.extract(page.format(text, ""), {}) == text
    assert html_text.extract(page.replace("article", "main").format(text, ""), {}).startswith("The text")
    for hidden in ("<div class='comments'><article class='comment'><p>not this one</p></article></div>",
                   "<aside><article><p>nor this one</p></article></aside>"):
        assert html_text.extract(page.format(text, hidden), {}) == text


def test_odd_markup_takes_linear_time():
    """Pages of about 1 MB that used to take minutes."""
    import time
    n = 1 << 20
    for piece in ("<a>x ", "<p ", "<p \"", "<b><div/>", "<div>y ", "</title ", "<p><q><b>", "<!-", "<title></title", "<a '\">",
                  "<p><custom><b>", "</x>", "<", "&amp;", "<li>z"):
        page = "<main><p>Some words of the text.</p>" + piece * (n // len(piece))
        t = time.time()
        assert html_text.extract(page, {}).startswith("Some words of the text")
        assert time.time() - t < 12, piece
    nested = "<p><custom>" + "<b>" * 50_000 + "<div/>" * 50_000 + "words"
    t = time.time()
    html_text.extract(nested, {})
    assert time.time() - t < 5


def test_parts_of_longer_names_are_no_hints_inside_an_article():
    page = "<body><article><p>First part.</p><div class='share-price'>The price rose.</div>" \
           "<div class='share'>Send this</div><p>Last part.</p></article><div class='share-buttons'>Mail</div></body>"
    assert html_text.extract(page, {}) == "First part.\n\nThe price rose.\n\nLast part."


def test_tokens_of_broken_tags():
    t = lambda page: [x[:2] for x in html_text.tokens(page)]
    assert t("a < b <p>c") == [("text", "a < b "), ("open", "p"), ("text", "c")]
    assert t("<p title='a>b'>c</p>") == [("open", "p"), ("text", "c"), ("close", "p")]
    assert t("<p title='a>c") == [("open", "p"), ("text", "c")]
    assert t("x<!-- <p> -->y<br/>z<?q ?></ >w") == [("text", "x"), ("text", "y"), ("void", "br"), ("text", "z"), ("text", "w")]
    assert t("<script>a<p></SCRIPT >b<p") == [("open", "script"), ("close", "script"), ("text", "b<p")]
    assert t("<textarea>q") == [("open", "textarea"), ("close", "textarea")]


def test_logistic_fit_converges():
    """Separable, nearly separable, constant and one-sided columns: finite
    weights, a loss below the start's, and no smaller one nearby."""
    r = np.random.default_rng(4)
    for k in range(40):
        n = 400
        y = (r.random(n) < 0.1).astype(float)
        top = np.where(y == 1, 0.9, 0.05) + r.normal(0, 10.0 ** -r.integers(0, 6), n)
        x = np.c_[np.log1p(np.abs(top) * r.integers(1, 9)), top, r.normal(0, 1e-6, n)]
        if k % 4 == 0:
            x[:, 0] = 0.0
        w = toxicity.fit_logistic(x, y)
        full = np.c_[np.ones(n), x]

        def loss(w):
            z = full @ w
            return np.logaddexp(0, z).sum() - y @ z + 0.005 * w @ w
        assert np.isfinite(w).all() and (w[1:] >= 0).all() and loss(w) < loss(np.zeros(4))
        for _ in range(60):
            near = w + r.normal(0, 0.05, 4)
            near[1:] = np.maximum(near[1:], 0)
            assert loss(near) >= loss(w) - 1e-6 * max(1.0, loss(w))
