"""Similarity sketches of hashed shingle sets, for whole slices of documents at once."""

from __future__ import annotations

import numpy as np

from .text import U, mix


def fast_sketch(sets: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketching: t values per set, equal sets giving equal sketches.

    Round i hashes every element to a bin and a value above those of earlier rounds;
    a bin keeps its least value. In rounds 0 to t-1 the bin is random, in rounds t to
    2t-1 it is i-t for every element, so every coordinate is surely filled; a set
    stops as soon as all are. Coordinates agree with the Jaccard similarity as
    probability, as concentrated as with t independent permutations or more. An
    empty set keeps the highest value everywhere.
    """
    n = len(bounds) - 1
    top = np.iinfo(np.uint64).max
    out = np.full((n, t), top, U)
    sizes = np.diff(bounds)
    live = sizes > 0
    row = np.repeat(np.arange(n), sizes)
    element = sets
    for i in range(2 * t):
        if not live.any():
            break
        if i:
            take = live[row]
            row, element = row[take], element[take]
        h = mix(element, 5000 + i)
        place = (h % U(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = (U(i) << U(55)) | (mix(h, 1) >> U(9))
        np.minimum.at(out.reshape(-1), row * t + place, value)
        at = np.flatnonzero(live)
        live[at] = (out[at] == top).any(axis=1)
    return out


def permutation_sketch(sets: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash: the least value of each set under len(a) multiply-add permutations modulo 2**64.

    An empty set keeps the highest value everywhere.
    """
    n = len(bounds) - 1
    out = np.full((n, len(a)), np.iinfo(np.uint64).max, U)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        starts = bounds[some]
        for k in range(len(a)):
            value = sets * a[k] + b[k]
            out[some, k] = np.minimum.reduceat(value ^ (value >> U(32)), starts)
    return out


def bands(sketch: np.ndarray, rows: int, count: int) -> np.ndarray:
    """Hashes of ``count`` bands of ``rows`` coordinates each; the band's number is part of its hash."""
    out = np.zeros((len(sketch), count), U)
    for b in range(count):
        h = np.full(len(sketch), b + 1, U)
        for r in range(rows):
            h = mix(h * U(3) + sketch[:, b * rows + r], 77)
        out[:, b] = h
    return out


def banding(threshold: float, t: int, miss: float = 1e-6) -> tuple[int, int]:
    """The longest bands that lose a pair at the threshold with probability ``miss`` at most."""
    for rows in range(16, 0, -1):
        count = t // rows
        if (1 - threshold**rows) ** count <= miss:
            return rows, count
    return 1, t
