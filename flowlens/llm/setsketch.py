"""Shingle sets and SetSketch registers, vectorised over many texts.

A text's set holds 64-bit hashes of its distinct 2-word shingles (words are
runs of bytes other than ASCII white space, A-Z lower-cased).  A register is
``floor(1 - log_b(x))`` of the smallest of the set's exponential values ``x``
of rate ``RATE``, truncated to 0 .. ``LEVELS``: registers of a union are the
larger ones of its parts, and two sets of likeness J agree in a register with
a probability just above J.
"""

from __future__ import annotations

import hashlib

import numpy as np

REGISTERS, BAND = 200, 5
BASE, RATE, LEVELS = 1.02, 20.0, 65_535
LONG_WORD = 64

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_XOR = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of lower-cased bytes."""
    a = np.frombuffer(data, np.uint8)
    gap = np.r_[True, _SPACE[a], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    n = end - start
    h = np.zeros(len(start), np.uint64)
    live = np.flatnonzero(n <= LONG_WORD)
    at, left = start[live], n[live]
    k = 0
    while len(live):
        h[live] = h[live] * _P + _BYTE[a[at + k]]
        k += 1
        more = left > k
        if not more.all():
            live, at, left = live[more], at[more], left[more]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]], digest_size=8).digest(), "little")
    return mix(h), start


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of one word has
    that word as its only shingle, one without words none."""
    raw = [t.encode("utf-8").lower() for t in texts]
    h, start = word_hashes(b"\n".join(raw))
    size = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.searchsorted(start, np.r_[0, np.cumsum(size)])
    pair = mix(h[:-1] * _P + (h[1:] ^ (h[1:] << np.uint64(21)))) if len(h) else h
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        out.append(np.unique(pair[a:b - 1]) if b - a >= 2 else mix(h[a:b] + np.uint64(1)))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(set, register) array of uint16; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(some):
        return out
    every = np.concatenate([sets[i] for i in some])
    at = np.r_[0, np.cumsum([len(sets[i]) for i in some])[:-1]]
    least = np.empty((len(some), REGISTERS), np.uint64)
    buf = np.empty_like(every)
    for r in range(REGISTERS):
        np.bitwise_xor(every, _XOR[r], out=buf)
        np.multiply(buf, _MUL[r], out=buf)
        least[:, r] = np.minimum.reduceat(buf, at)
    x = -np.log1p(-np.minimum((least.astype(np.float64) + 1) * 2.0**-64, 1 - 1e-15)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """(set, band) keys: a hash of the band's number and its registers."""
    n, m = regs.shape
    parts = regs.reshape(n, m // BAND, BAND).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, m // BAND + 1, dtype=np.uint64)), (n, m // BAND)).copy()
    for j in range(BAND):
        key = mix(key * _P + parts[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def _log_p(x):
    """log p_b(x), p_b(x) = -log_b(1 - x (b - 1) / b)."""
    return np.log(np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12))


def log_likelihood(j, above, below, same, nu, nv):
    """Of likeness j, when ``above`` registers of U exceed those of V (sizes
    nu and nv), ``below`` are exceeded and ``same`` agree."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    pa, pb = _log_p(u - v * j), _log_p(v - u * j)
    return above * pa + below * pb + same * np.log(np.maximum(1 - np.exp(pa) - np.exp(pb), 1e-12))


def may_reach(limit: float, ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray,
              margin: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(joint maximum-likelihood likeness, whether ``limit`` or more is
    possible): false only where the best likelihood beats that of every
    likeness from ``limit`` up by a factor of e**margin."""
    above, below = (ku > kv).sum(1), (ku < kv).sum(1)
    same = ku.shape[1] - above - below
    top = np.minimum(nu / nv, nv / nu)
    lo, hi = np.zeros(len(nu)), top.astype(float)

    def value(j):
        return log_likelihood(j, above, below, same, nu, nv)
    for _ in range(40):  # the likelihood is concave in j
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        right = value(a) < value(b)
        lo, hi = np.where(right, a, lo), np.where(right, hi, b)
    best = (lo + hi) / 2
    at_limit = value(np.minimum(np.maximum(best, limit), top))
    return best, (top >= limit - 1e-9) & (value(best) - at_limit <= margin)
