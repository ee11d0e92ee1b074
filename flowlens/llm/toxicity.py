"""Operator 5, toxicity: a linear-chain CRF tags toxic spans.

1. Labelled rows: all documents with a label that are not held out; equal texts
   of one label are one row with a count.  Every step learns from all of them.
2. Token features are a word and its prefixes.  Spark counts in how many toxic
   and other labelled documents each occurs; those that are significantly
   toxic (log-likelihood ratio) form the lexicon, at most ``MAX_FEATURES``.
3. Labelled tokens: in a toxic document those with a lexicon feature, no
   others.  The CRF is trained on the places of these tokens in all labelled
   documents, by gradients that Spark sums; a class of more than ``SEQUENCES``
   documents weighs as much as so many.  Its forward-backward marginals tag
   every token of every document.
4. A document's marginals aggregate to their sum, largest value and share; a
   logistic model, fitted on the labelled documents by Newton's method with
   sums from Spark, turns these into the score.  Spans are runs of tokens with a marginal of at least 0.5, given as
   character offsets.

Scores use the text only.  Scoring is a map over rows, without a shuffle;
memory is one slice of texts.

Defined cases: a null text is an empty one and scores as a document without
any toxic token; a null id is never held out and never a labelled row; null
labels are not used; without labelled rows of both classes every score is the
share of toxic labels (0 without any); repeated rows give repeated results;
an empty table an empty one; other columns are kept by ``keep_clean`` and not
read by ``score``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import crf
from flowlens.llm.bpe import Memo
from flowlens.llm.common import bounded_batches, map_columns, slices, stored, whole_text

MAX_FEATURES = 4_000
#: Documents that a class weighs at most in the CRF's training.
SEQUENCES = 800
#: Documents, and about tokens of them, that a training step holds at a time.
BLOCK_ROWS, BLOCK_TOKENS = 8192, 1 << 18
#: Step sizes of Newton's method that one Spark job tries.
AHEAD = 4
#: Text bytes that one call tags.
SLICE = 2 << 20
#: Words whose emission a worker remembers; others are computed anew.
MEMO_WORDS = 100_000
PREFIXES = (3, 4, 5, 6)
MIN_LLR, MIN_ODDS = 24.0, 8.0
THRESHOLD = 0.3
HELD_OUT = 2

_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[str]:
    return [f"={word}", *[word[:k] for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)   # lexicon feature -> emission weight
    bias: float = -3.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logit: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        w = self.weight
        return self.bias + sum(w.get(f, 0.0) for f in features(word))


def aggregates(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's marginals add up to."""
    total = float(p.sum())
    return np.log1p(total), float(p.max(initial=0.0)), total / max(len(p), 1)


class Tagger:
    """Applies a model to slices of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = Memo(model.emission, MEMO_WORDS)

    def marginals(self, texts: list[str]):
        """(p of all tokens, token count of each text)."""
        lengths, streams = [], []
        for t in texts:
            words = _WORD.findall(t.lower())
            lengths.append(len(words))
            streams.append(np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words)))
        lengths = np.array(lengths, np.int64)
        p = crf.marginals(np.concatenate(streams) if streams else np.zeros(0), lengths, self.model.trans)
        return p, lengths

    def __call__(self, texts: list[str], with_spans: bool = True):
        """(aggregates, spans) of each text."""
        p, lengths = self.marginals(texts)
        stats, spans, at = np.zeros((len(texts), 3)), [], 0
        for i, n in enumerate(lengths.tolist()):
            q = p[at:at + n]
            at += n
            stats[i] = aggregates(q)
            spans.append(offsets(texts[i], q) if with_spans and stats[i, 1] >= 0.5 else [])
        return stats, spans

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = self.model.logit[0] + stats @ self.model.logit[1:]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def offsets(text: str, p: np.ndarray) -> list[dict]:
    """Character spans of the runs of tokens with p >= 0.5."""
    out, last = [], -2
    # lower() may change a string's length, so the places are taken in the text
    # itself; should the two token counts differ, the text is taken letter by letter
    tokens = list(_WORD.finditer(text))
    if len(tokens) != len(p):
        tokens = list(_WORD.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in text)))[:len(p)]
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i >= len(tokens):
            break
        a, b = tokens[i].span()
        if i == last + 1:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
        last = i
    return out


def llr(a, b, c, d):
    """Log-likelihood ratio of a 2x2 table."""
    def h(*x):
        x = np.stack([np.asarray(v, float) for v in x])
        return np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0).sum(0)
    return 2 * (h(a, b, c, d) + h(a + b + c + d) - h(a + b, c + d) - h(a + c, b + d))


def covered(counts) -> set[str]:
    """Prefixes that a longer feature makes needless: it has most of their
    toxic documents and fewer of the others."""
    toxic, other = (dict(zip(counts["f"], counts[c])) for c in ("toxic", "other"))
    out = set()
    for g in toxic:
        word = g.removeprefix("=")
        for f in (word[:k] for k in PREFIXES if k < len(word)):
            if f in toxic and toxic[g] >= 0.8 * toxic[f] and other[g] < other[f]:
                out.add(f)
    return out


def logistic_sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(loss, gradient, curvature) of rows that count ``n`` times each, flat."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    return np.r_[float(n @ np.logaddexp(0, z) - (n * y) @ z), x.T @ (n * (y - p)),
                 ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()]


def newton(sums, width: int, steps: int, l2: float, ahead: int) -> np.ndarray:
    """Newton's method with a small ridge; no weight but the bias is negative.
    Weights that the bound holds at 0 stay out of a step, and a step is halved
    until it lowers the loss, so it converges on separable classes, too.
    ``sums`` gives the rows' ``logistic_sums`` at up to ``ahead`` places."""
    def at(places):
        return [(s[0] + l2 / 2 * w @ w, s[1:1 + width] - l2 * w, s[1 + width:].reshape(width, width))
                for w, s in zip(places, sums(places))]
    w = np.zeros(width)
    (now, gradient, h), = at([w])
    for _ in range(steps):
        free = (w > 0) | (gradient > 0)
        free[0] = True
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)] + l2 * np.eye(int(free.sum())), gradient[free])
        size, better = 1.0, None
        while size > 1e-9 and better is None:
            new = [w + size / 2 ** k * step for k in range(ahead)]
            for v in new:
                v[1:] = np.maximum(v[1:], 0)
            better = next(((v, found) for v, found in zip(new, at(new)) if found[0] < now), None)
            size /= 2 ** ahead
        if better is None:
            break
        w, (then, gradient, h) = better
        done, now = now - then < 1e-10 * max(1.0, now), then
        if done:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, l2: float = 1e-2) -> np.ndarray:
    """``newton`` on the rows of an array."""
    x, n = np.c_[np.ones(len(x)), x], np.ones(len(x))
    return newton(lambda places: [logistic_sums(x, y, n, w) for w in places], x.shape[1], steps, l2, 1)


def fit_logistic_blocks(blocks: RDD, width: int, steps: int = 100, l2: float = 1e-2) -> np.ndarray:
    """``newton`` on blocks (x, y, n) of rows of ``width`` columns."""
    def sums(places):
        def run(part):
            total = np.zeros((len(places), 1 + (width + 1) * (width + 2)))
            for x, y, n in part:
                x = np.c_[np.ones(len(x)), x]
                total += [logistic_sums(x, y, n, w) for w in places]
            yield total
        return sum(blocks.mapPartitions(run).collect())
    return newton(sums, width + 1, steps, l2, AHEAD)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, y, copies`` of all labelled documents.  The labels are broadcast, an
    id and a number a row: a join by shuffle would move nearly all texts."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")) \
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(id_col)) \
        .groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return texts.join(F.broadcast(rows), "id").groupBy("text", (F.col("y") == 1).cast("int").alias("y")) \
        .agg(F.count("*").alias("copies"))


def _blocks(rows):
    """Rows of ``sequences`` in lists of bounded size."""
    part, tokens = [], 0
    for r in rows:
        if part and (len(part) == BLOCK_ROWS or tokens + r.n > BLOCK_TOKENS):
            yield part
            part, tokens = [], 0
        part.append(r)
        tokens += r.n
    if part:
        yield part


def crf_block(rows, weight: list[float]) -> crf.Block:
    return crf.block([r.n for r in rows], [r.y for r in rows], [weight[r.y] * r.copies for r in rows],
                     [r.at for r in rows], [r.features for r in rows])


def logistic_block(rows, weights: np.ndarray, bias: float, trans: np.ndarray):
    """(aggregates, labels, copies) of rows of ``sequences``."""
    lengths = np.array([r.n for r in rows], np.int64)
    start = np.cumsum(lengths) - lengths
    emission = np.full(int(lengths.sum()), bias)
    token = [s + i for s, r in zip(start.tolist(), rows) for i, f in zip(r.at, r.features) for _ in f]
    np.add.at(emission, np.array(token, np.int64), weights[[i for r in rows for f in r.features for i in f]])
    p = crf.marginals(emission, lengths, trans)
    stats = [aggregates(p[s:s + n]) for s, n in zip(start.tolist(), lengths.tolist())]
    return np.array(stats), np.array([r.y for r in rows], float), np.array([r.copies for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    known = stored(labelled(docs, labels, id_col, text_col, label_col), "labelled")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not toxic or not other:
        model.logit = np.array([35.0 if toxic else -35.0, 0.0, 0.0, 0.0])
        return model

    def count(rows):
        found: dict[str, list[int]] = {}
        for text, y in zip(rows["text"], rows["y"]):
            for f in {f for w in set(_WORD.findall(text.lower())) for f in features(w)}:
                found.setdefault(f, [0, 0])[y] += 1
        return {"f": list(found), "other": [v[0] for v in found.values()], "toxic": [v[1] for v in found.values()]}
    # copies of one text speak once
    counts = map_columns(known.select("text", "y"), count, "f string, other long, toxic long", SLICE) \
        .groupBy("f").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")) \
        .where(F.col("toxic") >= 3) \
        .where((F.col("toxic") + 0.5) / (F.col("other") + 0.5) >= MIN_ODDS * (toxic / other)) \
        .orderBy(F.desc(F.col("toxic") / (F.col("other") + 1)), "f").limit(4 * MAX_FEATURES).toPandas()
    g = llr(counts["toxic"], counts["other"], toxic - counts["toxic"], other - counts["other"]) if len(counts) else []
    counts["llr"] = g
    counts = counts[~counts["f"].isin(covered(counts))]
    counts = counts[counts["llr"] >= MIN_LLR].sort_values(["llr", "f"], ascending=[False, True])[:MAX_FEATURES]
    number = {f: i for i, f in enumerate(sorted(counts["f"]))}

    # where the lexicon's words stand
    def tokens_of(rows):
        memo = Memo(lambda w: [number[f] for f in features(w) if f in number], MEMO_WORDS)
        out = {"y": rows["y"], "copies": rows["copies"], "n": [], "at": [], "features": []}
        for text in rows["text"]:
            found = list(map(memo.__getitem__, _WORD.findall(text.lower())))
            at = [i for i, f in enumerate(found) if f]
            out["n"].append(len(found))
            out["at"].append(at)
            out["features"].append([found[i] for i in at])
        return out
    key = ["y", "n", "at", "features"]
    sequences = map_columns(known, tokens_of, "y int, copies long, n long, at array<long>, features array<array<int>>", SLICE) \
        .groupBy(*key).agg(F.sum("copies").alias("copies"))
    rows = stored(sequences.sortWithinPartitions(*key), "sequences").rdd
    weight = [min(1.0, SEQUENCES / n) for n in (other, toxic)]
    blocks = rows.mapPartitions(lambda part: (crf_block(b, weight) for b in _blocks(part))) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights, bias, trans = crf.train(blocks, len(number), weight[0] * other + weight[1] * toxic)
    finally:
        blocks.unpersist()
    model.bias, model.trans = bias, trans
    model.weight = {f: float(weights[i]) for f, i in number.items()}
    blocks = rows.mapPartitions(lambda part: (logistic_block(b, weights, bias, trans) for b in _blocks(part))) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model.logit = fit_logistic_blocks(blocks, 3)
    finally:
        blocks.unpersist()
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of every document."""
    cached: list[Tagger] = []

    def run(rows):
        if not cached:
            cached.append(Tagger(model))
        stats, spans = cached[0](rows["text"])
        s = cached[0].score(stats)
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": s.tolist(),
                "predicted": (s >= threshold).astype(int).tolist(), "spans": spans}
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                         whole_text(text_col).alias("text"))
    return map_columns(picked, run, SCHEMA, SLICE)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        tagger = Tagger(model)
        for batch in batches:
            for part in slices(batch, SLICE):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                stats, _ = tagger(texts, with_spans=False)
                yield part.filter(pa.array(tagger.score(stats) < threshold))
    return docs.mapInArrow(run, docs.schema)
