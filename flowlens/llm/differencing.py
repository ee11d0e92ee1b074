"""Karmarkar-Karp multiway differencing of one bounded group of weights.

A partial partition is ``k`` window sums (in descending order, each with the
tree of items in it).  The heap starts with the items, sorted and taken ``k``
at a time; the two partial partitions of largest spread are merged again and
again, the largest window of one joining the smallest of the other, until one
partition is left.  When a window exceeds the capacity, the window count
rises by one and the group is partitioned anew.
"""

from __future__ import annotations

import heapq
import math

import numpy as np


def difference(weights: np.ndarray, k: int) -> np.ndarray:
    """Window (0 .. k-1) of each weight, near-equal window sums."""
    n = len(weights)
    order = np.argsort(-weights, kind="stable")
    # tree node i < n is item i, node n + j joins two nodes, -1 is an empty window
    left, right = [], []
    heap = []
    for no, at in enumerate(range(0, n, k)):
        part = order[at:at + k]
        sums = np.zeros(k, np.int64)
        node = np.full(k, -1, np.int64)
        sums[:len(part)], node[:len(part)] = weights[part], part
        heap.append((-int(sums[0] - sums[-1]), no, sums, node))
    heapq.heapify(heap)
    no = len(heap)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        b, bn = b[::-1], bn[::-1]
        sums = a + b
        both = (an >= 0) & (bn >= 0)
        node = np.where(an >= 0, an, bn)
        node[both] = n + len(left) + np.arange(int(both.sum()))
        left += an[both].tolist()
        right += bn[both].tolist()
        by = np.argsort(-sums, kind="stable")
        sums, node = sums[by], node[by]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), no, sums, node))
        no += 1
    window = np.full(n + len(left), -1, np.int64)
    if heap:
        node = heap[0][3]
        window[node[node >= 0]] = np.flatnonzero(node >= 0)
    for j in range(len(left) - 1, -1, -1):  # a joined node was made after its parts
        window[left[j]] = window[right[j]] = window[n + j]
    return window[:n]


def pack(weights: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each weight; every weight is at most ``capacity`` and so is
    every window sum.  Starts from the least possible window count."""
    weights = np.asarray(weights, np.int64)
    if not len(weights):
        return np.zeros(0, np.int64)
    k = max(1, math.ceil(int(weights.sum()) / capacity))
    while True:
        window = difference(weights, k)
        if np.bincount(window, weights=weights, minlength=k).max() <= capacity:
            return window
        k += 1
