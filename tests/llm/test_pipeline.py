"""The corpus pipeline, stage by stage, on the smallest tables."""

import random

import corpus_pipeline
import numpy as np
from odd import documents
from test_duplicates import accepted, bench, brute, latent_corpus, leading

from flowlens.llm import crf, latent, toxicity


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "benchmark", "packing"]
    from flowlens.llm.common import stored
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf_dir), name)
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.count()
            break
        assert after.columns == docs.columns
        assert after.join(before, docs.columns, "left_anti").isEmpty()
        if name == "near_duplicates":
            want = brute([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == set(want.values())
        before = after


def test_benchmark_stage_equals_brute_force(spark, tmp):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(16 + 5 * i))) for i in range(6)]
    docs = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(80))) for k in range(30)]
    for _, t in items:
        for share in (0, 20, 30, 40):  # words replaced, with and without the answer
            for end in (5, 0):
                w = t.split()
                for p in rng.sample(range(len(w) - end), min(len(w) - end, len(w) * share // 100)):
                    w[p] = "changed"
                body = [f"o{rng.randrange(10**6)}" for _ in range(90)]
                docs.append((len(docs), " ".join(body[:40] + w + body[40:])))
    bench(spark, items).write.parquet(f"{tmp}/stage/benchmark.parquet")
    df = documents(spark, docs)
    kept = dict(corpus_pipeline.STAGES)["benchmark"](spark, df, f"{tmp}/stage")
    assert kept.columns == df.columns
    want = {d for d, t in docs if not any(accepted(t, x) for _, x in items)}
    assert 30 < len(want) < len(docs) - 20
    assert {r.doc_id for r in kept.collect()} == want


def test_benchmark_stage_learns_from_all_documents(spark, tmp, monkeypatch):
    docs, items = latent_corpus()
    bench(spark, items).write.parquet(f"{tmp}/whole/benchmark.parquet")
    models, fit = [], latent.fit

    def watched(*args, **named):
        models.append(fit(*args, **named, rank=6))
        return models[-1]
    monkeypatch.setattr(latent, "fit", watched)
    dict(corpus_pipeline.STAGES)["benchmark"](spark, documents(spark, docs), f"{tmp}/whole")
    want = leading(docs, items, models[0], 6)
    assert np.allclose(np.linalg.svd(want.T @ models[0].space, compute_uv=False), 1, atol=1e-6)


def test_toxicity_stage_learns_from_all_labelled_rows(spark, tmp, monkeypatch):
    rows = [(i, f"text {i} of many " + ("zonk" if i % 2 else "words") + " here" * (i % 7)) for i in range(2400)]
    rows += [(10**6 + i, rows[i][1]) for i in range(5)]  # copies
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp}/all/labels.parquet")
    docs, seen, train, fit = documents(spark, rows), [], crf.train, toxicity.fit_logistic_blocks

    def watched_train(blocks, n_features, n_docs):
        for b in blocks.collect():
            last = np.cumsum(b.pieces) - 1
            seen.append(("crf", b.label[last], b.weight[last]))
        return train(blocks, n_features, n_docs)

    def watched_fit(blocks, width):
        seen.extend(("logistic", y, n) for _, y, n in blocks.collect())
        return fit(blocks, width)
    monkeypatch.setattr(crf, "train", watched_train)
    monkeypatch.setattr(toxicity, "fit_logistic_blocks", watched_fit)
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, f"{tmp}/all")
    known = [r.doc_id % 2 for r in docs.where(~toxicity.held_out()).collect()]
    sizes = [known.count(k) for k in (0, 1)]
    assert min(sizes) > toxicity.SEQUENCES  # a class's weight is bounded, its documents are not
    for k in (0, 1):
        assert sum(n[y == k].sum() for what, y, n in seen if what == "logistic") == sizes[k]
        assert np.isclose(sum(w[y == k].sum() for what, y, w in seen if what == "crf") / toxicity.SEQUENCES, 1)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 2 == 0}


def test_registered():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
