"""A two-state linear-chain conditional random field over token streams.

The score of a labelling y of tokens t is the sum of ``emission[t]`` where
``y[t] = 1`` and of ``trans[y[t-1], y[t]]``, with state 0 before the first
token.  ``marginals`` runs forward-backward over many documents at once: each
is cut into chunks of ``CHUNK`` tokens, a chunk's steps are multiplied into
one 2x2 matrix, the chunk matrices give each chunk's entry and exit vectors,
and a second sweep fills in the chunks.  The result is exact; only the order
of the multiplications differs from the textbook loop.

Training reads documents as ``Block`` objects in an RDD.  A document's tokens
without a feature all have the same step matrix, so a run of them is a power of
it: ``gradient`` takes time by the tokens with features, with the same result as
by all tokens.  A step of the optimiser sums the blocks' gradients, each in the
task that holds it; what travels is one gradient per task and the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import RDD

CHUNK = 32
PIECES = 4                 # of a chunk in training, where most documents have few
LIMIT = 30.0


def _layout(lengths: np.ndarray, size: int):
    """Chunks of each document: (first chunk, chunk count, place of each token)."""
    count = -(-lengths // size)
    first = np.cumsum(count) - count
    start = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) + np.repeat(first * size - start, lengths)
    return first, count, place


def _sweep(first: np.ndarray, count: np.ndarray, size: int, step):
    """(marginals of state 1 after each place, normalised forward vectors before
    it, backward vectors after it) of documents' chunks; ``step(j)`` gives the
    four entries of the step matrices at place j, identity in the padding."""
    n = int(count.sum())
    m00, m01, m10, m11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for j in range(size):
        s00, s01, s10, s11 = step(j)
        m00, m01, m10, m11 = (m00 * s00 + m01 * s10, m00 * s01 + m01 * s11,
                              m10 * s00 + m11 * s10, m10 * s01 + m11 * s11)
        norm = m00 + m01 + m10 + m11
        m00, m01, m10, m11 = m00 / norm, m01 / norm, m10 / norm, m11 / norm
    enter0, enter1 = np.ones(n), np.zeros(n)
    leave0, leave1 = np.full(n, 0.5), np.full(n, 0.5)
    by = np.argsort(-count, kind="stable")
    longest = int(count.max()) if len(count) else 0
    more = np.searchsorted(-count[by], -np.arange(1, longest + 1), side="right")
    for k in range(1, longest):  # chunk k of the documents that have it
        c = first[by[:more[k]]] + k
        p = c - 1
        a0 = enter0[p] * m00[p] + enter1[p] * m10[p]
        a1 = enter0[p] * m01[p] + enter1[p] * m11[p]
        enter0[c], enter1[c] = a0 / (a0 + a1), a1 / (a0 + a1)
    for k in range(longest - 1, 0, -1):
        c = first[by[:more[k]]] + k
        b0 = m00[c] * leave0[c] + m01[c] * leave1[c]
        b1 = m10[c] * leave0[c] + m11[c] * leave1[c]
        leave0[c - 1], leave1[c - 1] = b0 / (b0 + b1), b1 / (b0 + b1)
    before, after = np.empty((2, n, size)), np.empty((2, n, size))
    p = np.empty((n, size))
    a0, a1 = enter0, enter1
    now = np.empty((2, n, size))
    for j in range(size):
        before[0, :, j], before[1, :, j] = a0, a1
        s00, s01, s10, s11 = step(j)
        a0, a1 = a0 * s00 + a1 * s10, a0 * s01 + a1 * s11
        norm = a0 + a1
        a0, a1 = a0 / norm, a1 / norm
        now[0, :, j], now[1, :, j] = a0, a1
    b0, b1 = leave0, leave1
    for j in range(size - 1, -1, -1):
        after[0, :, j], after[1, :, j] = b0, b1
        one = now[1, :, j] * b1
        p[:, j] = one / (now[0, :, j] * b0 + one)
        s00, s01, s10, s11 = step(j)
        b0, b1 = s00 * b0 + s01 * b1, s10 * b0 + s11 * b1
        norm = b0 + b1
        b0, b1 = b0 / norm, b1 / norm
    return p, before, after


def forward_backward(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray):
    """(p, a, b, x): marginals of state 1, normalised forward vectors before
    each token, backward vectors after it, and exp(emission)."""
    lengths = np.asarray(lengths, np.int64)
    first, count, place = _layout(lengths, CHUNK)
    n = int(count.sum())
    used = np.zeros(n * CHUNK, bool)
    used[place] = True
    x = np.ones(n * CHUNK)
    x[place] = np.exp(np.clip(emission, -LIMIT, LIMIT))
    used, x = used.reshape(n, CHUNK), x.reshape(n, CHUNK)
    t = np.exp(np.clip(trans, -LIMIT, LIMIT))

    def step(j):
        """The four entries of the step matrices at place j; identity in the padding."""
        u, v = used[:, j], x[:, j]
        return (np.where(u, t[0, 0], 1.0), np.where(u, t[0, 1] * v, 0.0),
                np.where(u, t[1, 0], 0.0), np.where(u, t[1, 1] * v, 1.0))
    p, before, after = _sweep(first, count, CHUNK, step)

    def flat(v):
        return v.reshape(-1)[place]
    return (flat(p), np.stack([flat(before[0]), flat(before[1])]),
            np.stack([flat(after[0]), flat(after[1])]), flat(x))


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) of every token."""
    return forward_backward(emission, lengths, trans)[0]


@dataclass
class Block:
    """Documents as pieces: a run of ``gap`` tokens without features and the token
    with features behind it; a document's last piece is a run only.  The tokens
    with features have their document's label (0 or 1), all others 0."""
    gap: np.ndarray
    pieces: np.ndarray      # of each document
    label: np.ndarray       # of each piece
    weight: np.ndarray      # of each piece: its document's
    token_of: np.ndarray    # piece and number of each feature of a token
    feature_of: np.ndarray


def block(lengths: list[int], labels: list[int], weights: list[float], places: list[list[int]],
          features: list[list[list[int]]]) -> Block:
    """Documents of ``lengths`` tokens; ``places`` of the tokens with features."""
    pieces = np.array([len(at) + 1 for at in places], np.int64)
    ends = np.array([i for n, at in zip(lengths, places) for i in (*at, n)], np.int64)
    first = np.cumsum(pieces) - pieces
    start = np.r_[0, ends[:-1] + 1]
    start[first] = 0
    tokens = np.delete(np.arange(len(ends)), first + pieces - 1)
    found = [f for document in features for f in document]
    return Block(ends - start, pieces, np.repeat(labels, pieces), np.repeat(np.asarray(weights, float), pieces),
                 np.repeat(tokens, [len(f) for f in found]), np.array([i for f in found for i in f], np.int64))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of matrices that are followed by their derivatives, scaled."""
    out = a @ b[..., :1, :, :]
    out[..., 1:, :, :] += a[..., :1, :, :] @ b[..., 1:, :, :]
    return out / out[..., :1, :, :].sum((-2, -1), keepdims=True)


def _powers(step: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    out = np.zeros((len(exponents), *step.shape))
    out[:, 0] = np.eye(2)
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        odd = (exponents >> bit & 1).astype(bool)
        out[odd] = _times(out[odd], step)
        step = _times(step, step)
    return out


def gradient(docs: Block, theta: np.ndarray) -> np.ndarray:
    """The gradient of the documents' weighted log-likelihood at ``theta``: the
    features' weights, the bias, and the scores of 0 -> 1, 1 -> 0 and 1 -> 1."""
    n_features, n = len(theta) - 4, len(docs.gap)
    emission = np.full(n, theta[n_features])
    np.add.at(emission, docs.token_of, theta[docs.feature_of])
    x = np.exp(np.clip(emission, -LIMIT, LIMIT))
    t01, t10, t11 = np.exp(np.clip(theta[-3:], -LIMIT, LIMIT))
    other = np.exp(np.clip(theta[n_features], -LIMIT, LIMIT))
    one = np.array([[1, t01 * other], [t10, t11 * other]])
    gaps, at = np.unique(docs.gap, return_inverse=True)
    run = _powers(np.stack([one, *(one * part for part in ([[0, 1], [0, 0]], [[0, 0], [1, 0]], [[0, 0], [0, 1]]))]), gaps)[at]
    last = np.zeros(n, bool)
    last[np.cumsum(docs.pieces) - 1] = True
    first = np.r_[True, last[:-1]][:n]
    s00, s01, s10, s11 = (np.where(last, end, token) for end, token in ((1, 1), (0, t01 * x), (0, t10), (1, t11 * x)))
    g00, g01, g10, g11 = run[:, 0].reshape(n, 4).T
    steps = np.stack([g00 * s00 + g01 * s10, g00 * s01 + g01 * s11, g10 * s00 + g11 * s10, g10 * s01 + g11 * s11])
    chunk, count, place = _layout(docs.pieces, PIECES)
    padded = np.tile(np.array([1.0, 0, 0, 1])[:, None], (1, int(count.sum()) * PIECES))
    padded[:, place] = steps / steps.sum(0)
    padded = padded.reshape(4, -1, PIECES)
    _, before, after = _sweep(chunk, count, PIECES, lambda j: padded[:, :, j])
    a, b = (v.reshape(2, -1)[:, place] for v in (before, after))
    tail = np.stack([s00 * b[0] + s01 * b[1], s10 * b[0] + s11 * b[1]])
    into = np.stack([a[0] * g00 + a[1] * g10, a[0] * g01 + a[1] * g11])
    share = docs.weight / (into * tail).sum(0)
    inside = np.einsum("in,nkij,jn,n->k", a, run[:, 1:], tail, share, optimize=True)
    share = np.where(last, 0, share)
    pair = np.stack([into[0] * s01 * b[1], into[1] * s10 * b[0], into[1] * s11 * b[1]]) * share
    token, seen = ~last, docs.weight * docs.label
    rest = seen * token - pair[0] - pair[2]
    alone = first | (docs.gap > 0)
    out = np.empty(len(theta))
    out[:n_features] = np.bincount(docs.feature_of, weights=rest[docs.token_of], minlength=n_features)
    out[n_features] = rest.sum() - inside[0] - inside[2]
    out[-3:] = np.array([seen[token & alone].sum(), seen[~first & (docs.gap > 0)].sum(), seen[token & ~alone].sum()]) \
        - pair.sum(1) - inside
    return out


def train(blocks: RDD, n_features: int, n_docs: float, steps: int = 80, rate: float = 0.3, l2: float = 0.5):
    """(weights, bias, trans) by maximum likelihood (Adam) on all blocks, whose
    documents weigh ``n_docs``."""
    theta = np.zeros(n_features + 4)
    theta[n_features] = -3.0
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, steps + 1):
        def summed(part, now=theta.copy()):
            yield sum((gradient(docs, now) for docs in part), np.zeros_like(now))
        grad = (sum(blocks.mapPartitions(summed).collect(), np.zeros_like(theta)) - l2 * theta) / max(1.0, n_docs)
        mean = 0.9 * mean + 0.1 * grad
        var = 0.99 * var + 0.01 * grad ** 2
        theta += rate * (mean / (1 - 0.9 ** it)) / (np.sqrt(var / (1 - 0.99 ** it)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
