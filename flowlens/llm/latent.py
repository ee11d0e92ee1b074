"""Operator 8, benchmark decontamination by latent semantic retrieval.

1. The vocabulary is the words of the benchmark items.  One pass over all
   documents counts in how many each stands; IDF covers the whole corpus.
2. The TF-IDF passages of all documents and items go through a distributed
   randomised SVD: one more pass sums A^T A over the passages, and Spark jobs
   over its rows give A^T A Q, a matrix of vocabulary x rank; the driver
   orthonormalises.  A vocabulary of more than ``GRAM_WORDS`` words, whose A^T A
   would be too large for a task, takes A^T (A Q) from the stored passages
   instead.  ``rank`` singular vectors give the latent space.
3. Every document is cut into overlapping passages of 16, 24, 32, ... words, each
   compared with the items of its length class.  Two bounds that follow from the
   rule of step 4 pick the pairs of passage and item (``Bounds``): a paraphrase
   holds the item's answer, looked up as one run of words; a leak lacks few of
   the item's words, so a number of its rarer half stand close together.  No
   pair that the rule accepts is left out.
4. The longest common subsequence of item and passage surroundings
   (bit-parallel) decides: a leak has at least ``LCS`` of the item's words in
   order, a paraphrase at least ``LCS_ANSWER`` and the item's last ``ANSWER``
   words (its answer) in one piece.
5. Each find carries the cosine of passage and item in the latent space, in which
   words outside the vocabulary count in the passage's norm.  It is a score, not
   a gate: at this rank the space keeps a small part of an item, and no bound
   on the cosine follows from the rule.

Scoring is a map over documents; the model it needs is bounded by
``BLOCK_ITEMS`` items, and larger benchmarks are searched block by block.
Words are runs of letters and digits, lower-cased.

Defined cases: a null text is an empty one and has no passage; an item without
words is never found; items of equal text are all reported; repeated rows give
repeated results; an empty table or benchmark gives an empty result and keeps
all documents; other columns are kept by ``keep_clean`` and not read by
``leaks``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowlens.llm import setsketch as ss
from flowlens.llm.common import bounded_batches, slices, stored, whole_text

BLOCK_ITEMS = 4000
GRAM_WORDS = 5000          # a task's part of A^T A: at most 100 MB
STRIPE = 64                # rows of A^T A that are dense at a time
RANK, OVERSAMPLE, ITERATIONS = 128, 16, 2
LCS, LCS_ANSWER, ANSWER = 0.8, 0.6, 5
SHORTEST = 16
STEPS = 4                  # passages start every length / STEPS words
SLICE = 2 << 20
HITS = 4 << 20             # word places that a search holds at a time

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    raw = [(t or "").lower().encode("utf-8").translate(_KEEP) for t in texts]
    h, start = ss.word_hashes(b" ".join(raw))
    return h, np.searchsorted(start, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])


class Vocabulary:
    """Place of a word's hash among the benchmark's words, -1 elsewhere."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted, distinct
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            x = h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == x, at, -1)
        return out


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and the number of documents.  A task
    sends one row per word at most."""
    def run(batches):
        total, n = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            for part in slices(batch, SLICE):
                h, first = words_of(part.column("text").to_pylist())
                at = vocabulary(h)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                hit = np.flatnonzero(at >= 0)
                pairs = np.unique(doc[hit] * len(total) + at[hit])
                total += np.bincount(pairs % len(total), minlength=len(total))
                n += part.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used].astype(np.int64)),
                                          pa.array(np.r_[n, total[used]])], names=["word", "n"])
    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary.hashes), np.int64)
    known = rows[rows["word"] >= 0]
    df[known["word"].to_numpy()] = known["n"].to_numpy()
    return df, int(rows.loc[rows["word"] < 0, "n"].sum())


def ragged(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the ranges start, start + 1, ... of ``count`` values."""
    row = np.repeat(np.arange(len(count)), count)
    return row, start[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]


def run_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of the ``ANSWER`` words from each place on."""
    n = max(0, len(h) - ANSWER + 1)
    out = np.zeros(n, np.uint64)
    for k in range(ANSWER):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Bounds:
    """Bounds that every passage accepted by the rule keeps.

    An item of n words may lack n - need of them.  Of any s of its words at
    least s - (n - need) are then in the common subsequence, each at a place of
    its own: so many places of these words lie within the surroundings."""

    def __init__(self, items: list[np.ndarray], places: list[np.ndarray], idf: np.ndarray):
        rare, self.least = [], np.zeros(len(items), np.int64)
        for i, at in enumerate(places):
            n = len(at)
            lack = n - next(k for k in range(n + 1) if k / n >= LCS)
            s = max(lack + 1, -(-n // 2))
            rare.append(np.unique(at[np.argsort(-idf[at], kind="stable")[:s]]))
            self.least[i] = s - lack
        self.rare_item = np.repeat(np.arange(len(items)), [len(r) for r in rare])
        self.rare_word = np.concatenate(rare)
        # shorter items are their own answer, which the first bound finds
        answers = np.array([run_hashes(x[-ANSWER:])[0] if len(x) >= ANSWER else 0 for x in items], np.uint64)
        order = np.argsort(answers, kind="stable")
        self.answer_item = order[[len(items[i]) >= ANSWER for i in order]]
        self.answers, self.answer_start, self.answer_count = np.unique(
            answers[self.answer_item], return_index=True, return_counts=True)
        self.answer_at = Vocabulary(self.answers)

    def spans(self, window: np.ndarray, h: np.ndarray, at: np.ndarray, first: np.ndarray):
        """(item, first place, last place) of words that have to lie in one
        passage's surroundings, by groups of items."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known = np.r_[0, np.cumsum(at >= 0)]
        start = np.flatnonzero(known[ANSWER:] - known[:-ANSWER] == ANSWER) if len(at) >= ANSWER else at[:0]
        start = start[text[start] == text[start + ANSWER - 1]]
        if len(start) and len(self.answers):
            hit = self.answer_at(run_hashes(h)[start])
            start, hit = start[hit >= 0], hit[hit >= 0]
            row, k = ragged(self.answer_start[hit], self.answer_count[hit])
            yield self.answer_item[k], start[row], start[row] + ANSWER - 1
        word = np.flatnonzero(at >= 0)
        word = word[np.argsort(at[word], kind="stable")]
        count = np.bincount(at[word], minlength=int(self.rare_word.max()) + 1)
        begin = np.cumsum(count) - count
        size = np.bincount(self.rare_item, count[self.rare_word], len(self.least)).astype(np.int64)
        pairs = np.flatnonzero((size >= self.least)[self.rare_item] & (count[self.rare_word] > 0))
        if not len(pairs):
            return
        # the pairs are in order of items; a group's places are at most HITS and those of one item
        group = np.cumsum(np.where(size >= self.least, size, 0)) // HITS
        for part in np.split(pairs, np.flatnonzero(np.diff(group[self.rare_item[pairs]])) + 1):
            w = self.rare_word[part]
            row, k = ragged(begin[w], count[w])
            item, place = np.divmod(np.sort(self.rare_item[part][row] * len(at) + word[k]), max(1, len(at)))
            last = np.arange(len(item)) + self.least[item] - 1
            a = np.flatnonzero(last < len(item))
            b = last[a]
            a, b = (x[(item[a] == item[b]) & (text[place[a]] == text[place[b]])
                      & (place[b] - place[a] < 2 * window[item[a]])] for x in (a, b))
            yield item[a], place[a], place[b]

    def passages(self, window: np.ndarray, h: np.ndarray, at: np.ndarray, first: np.ndarray):
        """(text, item, start, end) of the passages that keep a bound."""
        found = []
        for item, low, high in self.spans(window, h, at, first):
            text = np.searchsorted(first, low, "right") - 1
            w, origin = window[item], first[text]
            step, reach = w // STEPS, w // 2
            count = np.maximum(1, -(-(first[text + 1] - origin - w) // step) + 1)
            j0 = np.maximum(0, -(-(high + 1 - w - reach - origin) // step))
            j1 = np.minimum(count - 1, (low + reach - origin) // step)
            row, j = ragged(j0, np.maximum(0, j1 - j0 + 1))
            found.append(np.unique(np.stack([text[row], item[row], origin[row] + j * step[row]], 1), axis=0))
        if found:
            for text, item, start in np.unique(np.concatenate(found), axis=0).tolist():
                yield text, item, start, min(start + int(window[item]), int(first[text + 1]))


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray            # of the vocabulary
    other_idf: float           # of any other word
    space: np.ndarray          # vocabulary x rank, float32, orthonormal columns
    kept: float                # share of the items' energy that the space keeps
    item_ids: list[int]
    items: list[np.ndarray]    # word hashes
    latent: np.ndarray         # item x rank, unit vectors
    window: np.ndarray         # passage length that an item is searched in
    bounds: Bounds


def window_of(n: int) -> int:
    w = SHORTEST
    while w < n:
        w = w * 3 // 2 if w & (w - 1) == 0 else w * 4 // 3  # 16, 24, 32, 48, 64, ...
    return w


def passages_of(texts: list[str], whole: list[bool], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(vocabulary words, first word of each passage and the end): a text is
    cut every 32 words, or one passage where ``whole``."""
    h, first = words_of(texts)
    at = vocabulary(h)
    text, k = ragged(np.zeros(len(texts), np.int64), np.where(whole, 1, -(-np.diff(first) // 32)))
    known = np.flatnonzero(at >= 0)
    return at[known], np.searchsorted(known, np.r_[first[text] + 32 * k, len(at)])


def _pieces(vocabulary: Vocabulary | None):
    """Reads batches of rows (text, whole) as ``passages_of`` gives them;
    without a vocabulary, of rows ``words array<int>``, a passage each."""
    def read(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                if vocabulary is None:
                    words = part.column("words")
                    yield (words.flatten().to_numpy(zero_copy_only=False),
                           np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
                else:
                    yield passages_of(part.column("text").to_pylist(), part.column("whole").to_pylist(), vocabulary)
    return read


def weighed(w: np.ndarray, first: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, weight) of the passages' unit TF-IDF vectors, in order."""
    passage = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cell, tf = np.unique(passage * len(idf) + w, return_counts=True)
    row, w = np.divmod(cell, len(idf))
    x = tf * idf[w]
    return row, w, x / np.sqrt(np.bincount(row, x * x))[row]


#: A part of a matrix's row ``word``: columns (int32) and values (float64).
CELLS = "word int, columns binary, cells binary"


def _written(rows):
    rows = iter(rows)
    while group := list(islice(rows, STRIPE)):
        yield pa.RecordBatch.from_arrays([
            pa.array([w for w, _, _ in group], pa.int32()),
            pa.array([c.astype(np.int32).tobytes() for _, c, _ in group], pa.binary()),
            pa.array([x.tobytes() for _, _, x in group], pa.binary())], names=["word", "columns", "cells"])


def _read(batch: pa.RecordBatch):
    for w, c, x in zip(*(batch.column(k).to_pylist() for k in ("word", "columns", "cells"))):
        yield w, np.frombuffer(c, np.int32), np.frombuffer(x)


def summed(parts: DataFrame, width: int) -> DataFrame:
    """The sum of each word's parts, one row per word."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, c, x in _read(batch):
                if w not in total:
                    total[w] = np.zeros(width)
                total[w][c] += x
        yield from _written((w, np.flatnonzero(x), x[x != 0]) for w, x in total.items())
    return parts.repartition("word").mapInArrow(run, CELLS)


def gram(passages: DataFrame, idf: np.ndarray, vocabulary: Vocabulary | None) -> DataFrame:
    """A^T A, A's rows the unit TF-IDF vectors of the passages: the cells
    (word, column <= word) in one pass; a task sums its own part."""
    n, read = len(idf), _pieces(vocabulary)

    def run(batches):
        total = np.zeros(n * (n + 1) // 2)
        for w, first in read(batches):
            row, w, x = weighed(w, first, idf)
            line, near = w * (w + 1) // 2, np.arange(len(w))
            for k in range(n):  # each word and the k-th one behind it in its passage
                near = near[near < len(w) - k]
                near = near[row[near + k] == row[near]]
                if not len(near):
                    break
                np.add.at(total, line[near + k] + w[near], x[near] * x[near + k])
        lines = ((i, total[i * (i + 1) // 2:(i + 1) * (i + 2) // 2]) for i in range(n))
        yield from _written((i, np.flatnonzero(x), x[x != 0]) for i, x in lines if x.any())
    return stored(summed(passages.mapInArrow(run, CELLS), n), "gram")


def gram_times(cells: DataFrame, q: np.ndarray) -> np.ndarray:
    """(A^T A) q of the cells that ``gram`` gives."""
    def run(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, STRIPE):
                rows = list(_read(batch.slice(at, STRIPE)))
                word, lines = np.array([w for w, _, _ in rows]), np.zeros((len(rows), len(q)))
                for line, (_, c, x) in zip(lines, rows):
                    line[c] = x
                total[word] += lines @ q
                lines[np.arange(len(word)), word] = 0
                total += lines.T @ q[word]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])
    parts = cells.coalesce(8).mapInArrow(run, "part binary").toLocalIterator()
    return sum((np.frombuffer(r.part).reshape(q.shape) for r in parts), np.zeros(q.shape))


def times_gram(passages: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A^T (A q) from the passages' words; a task sums its own part."""
    width, read = q.shape[1], _pieces(None)

    def starts(x):
        return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])

    def run(batches):
        total = np.zeros(q.shape)
        for w, first in read(batches):
            rows, words, weights = weighed(w, first, idf)
            cut = np.searchsorted(rows, np.arange(0, len(first) + 255, 256))
            for a, b in zip(cut[:-1], cut[1:]):
                if a < b:
                    row, w, x = rows[a:b], words[a:b], weights[a:b, None]
                    begin = starts(row)
                    y = np.add.reduceat(x * q[w], begin).repeat(np.diff(np.r_[begin, len(row)]), 0) * x
                    order = np.argsort(w, kind="stable")
                    begin = starts(w[order])
                    total[w[order][begin]] += np.add.reduceat(y[order], begin)
        yield from _written((i, np.arange(width), x) for i, x in enumerate(total) if x.any())
    out = np.zeros(q.shape)
    for r in summed(passages.mapInArrow(run, CELLS), width).toLocalIterator():
        out[r.word, np.frombuffer(r.columns, np.int32)] = np.frombuffer(r.cells)
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, vocabulary: Vocabulary | None = None) -> np.ndarray:
    """The leading right singular vectors of the passages' matrix; rows as
    ``_pieces`` reads them."""
    n = len(idf)
    if n <= GRAM_WORDS:
        cells = gram(passages, idf, vocabulary)
    elif vocabulary is not None:
        def rows(batches):
            for w, first in _pieces(vocabulary)(batches):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(first.astype(np.int32), w)], names=["words"])
        passages = stored(passages.mapInArrow(rows, "words array<int>"), "passages")

    def times(q):
        return gram_times(cells, q) if n <= GRAM_WORDS else times_gram(passages, idf, q)
    width = min(n, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(8).normal(size=(n, width)))[0]
    for _ in range(ITERATIONS):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ times(q))
    best = np.argsort(-values)[:min(rank, width)]
    return q @ vectors[:, best]


def fit(docs: DataFrame, items: list[tuple[int, str]], text_col: str = "text", rank: int = RANK) -> Model | None:
    """The model of one block of items; None when they have no words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    h, first = words_of([t for _, t in items])
    found = [(i, h[a:b]) for (i, _), a, b in zip(items, first[:-1], first[1:]) if b > a]
    if not found:
        return None
    vocabulary = Vocabulary(np.unique(h))
    df, n_docs = document_frequencies(docs, vocabulary, text_col)
    idf = np.log((n_docs + 1) / (df + 0.5)).clip(0.05)
    item_rows = spark.createDataFrame([(t, True) for _, t in items], "text string, whole boolean").coalesce(1)
    passages = docs.select(whole_text(text_col).alias("text"), F.lit(False).alias("whole")).unionAll(item_rows)
    space = randomised_svd(passages, idf, rank, vocabulary).astype(np.float32)
    latent, energy = np.zeros((len(found), space.shape[1]), np.float32), []
    for i, (_, x) in enumerate(found):
        at = vocabulary(x)
        latent[i] = idf[at].astype(np.float32) @ space[at]
        w, tf = np.unique(at, return_counts=True)
        energy.append(float((latent[i] ** 2).sum() / ((tf * idf[w]) ** 2).sum()))
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    words = [x for _, x in found]
    return Model(vocabulary, idf, float(np.median(idf)), space, float(np.mean(energy)), [i for i, _ in found], words,
                 latent, np.array([window_of(len(x)) for x in words]), Bounds(words, [vocabulary(x) for x in words], idf))


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def has_run(words: list[int], run: list[int]) -> bool:
    n = len(run)
    return any(words[i:i + n] == run for i, w in enumerate(words) if w == run[0])


def cosine_of(model: Model, at: np.ndarray, start: int, end: int, item: int) -> float:
    """The cosine of a passage and an item in the latent space."""
    a = at[start:end]
    k = a[a >= 0]
    z = model.idf[k].astype(np.float32) @ model.space[k]
    norm = np.sqrt((z * z).sum() + model.kept * (len(a) - len(k)) * model.other_idf ** 2)
    return float(z @ model.latent[item] / max(norm, 1e-9))


def find(model: Model, texts: list[str]) -> list[dict[int, tuple]]:
    """Per text: item -> (place of the passage, cosine, LCS share, answer
    found), of its first passage of the largest share."""
    h, first = words_of(texts)
    at = model.vocabulary(h)
    out: list[dict[int, tuple]] = [{} for _ in texts]
    for text, item, start, end in model.bounds.passages(model.window, h, at, first):
        words = model.items[item].tolist()
        reach = int(model.window[item]) // 2
        a, b = max(first[text], start - reach), min(first[text + 1], end + reach)
        around = h[a:b].tolist()
        there = set(around)
        if sum(map(there.__contains__, words)) < LCS_ANSWER * len(words):
            continue  # a common subsequence cannot be longer than this
        share = lcs_length(words, around) / len(words)
        if share < LCS_ANSWER:
            continue
        answer = has_run(around, words[-ANSWER:])
        if share >= LCS or answer:
            best = out[text].get(item)
            if best is None or share > best[2]:
                out[text][item] = (int(start - first[text]), cosine_of(model, at, start, end, item), share, answer)
    return out


SCHEMA = "doc_id long, item_id long, start_word long, cosine double, lcs_share double, answer_found boolean"


def _blocks(items: DataFrame, item_col: str, item_text_col: str):
    """The benchmark in blocks of at most ``BLOCK_ITEMS`` rows."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), whole_text(item_text_col).alias("t"))
    n = -(-rows.count() // BLOCK_ITEMS)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, benchmark item found in it)."""
    ddl = StructType.fromDDL(SCHEMA)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], ddl)

    def search(model):
        def run(batches):
            schema = to_arrow_schema(ddl)
            for batch in batches:
                for part in slices(batch, SLICE):
                    found = find(model, part.column("text").to_pylist())
                    rows = [(d, model.item_ids[i], *v) for d, f in zip(part.column("doc_id").to_pylist(), found)
                            for i, v in sorted(f.items())]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=schema)
        return run
    for n, block in enumerate(_blocks(items, item_col, item_text_col)):
        model = fit(docs, block, text_col)
        if model:
            found = picked.mapInArrow(search(model), ddl)
            out = found if n == 0 else out.unionAll(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without a benchmark item, with all their columns."""
    def clean(model):
        def run(batches):
            for batch in batches:
                for part in slices(batch, SLICE):
                    found = find(model, [t or "" for t in part.column(text_col).to_pylist()])
                    yield part.filter(pa.array([not f for f in found]))
        return run
    out = docs
    for block in _blocks(items, item_col, item_text_col):
        model = fit(docs, block, text_col)
        if model:
            out = out.mapInArrow(clean(model), docs.schema)
    return out
