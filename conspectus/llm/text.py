"""Words, shingles and mixing functions over whole Arrow text columns in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums
(the odd base has an inverse), and then mixed. Nothing loops over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
_PARTS = np.zeros(256, dtype=bool)
_PARTS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; seeds give independent functions."""
    x = x ^ U((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def words(texts: pa.Array, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each word's row, and its byte start and end.

    A-Z are lower-cased. Words are runs of bytes other than white space, or with
    ``letters_only`` runs of ASCII letters, digits and bytes above 127.
    """
    raw, bounds = flat(texts)
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    raw = _LOWER[raw]
    inside = _INSIDE[raw] if letters_only else ~_PARTS[raw]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * _power(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(U)), np.searchsorted(bounds, starts, side="right") - 1, starts, ends


_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row, ascending, with row bounds.

    A row of fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    out, bounds = [], np.zeros(n_rows + 1, np.int64)
    if len(hashes) >= k:
        full = np.zeros(len(hashes) - k + 1, U)
        for j in range(k):
            full = mix(full * U(3) + hashes[j : j + len(full)], j + 1)
    for r in range(n_rows):
        n = counts[r]
        if n >= k:
            own = np.sort(full[begin[r] : begin[r] + n - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif n:
            own = np.zeros(1, U)
            for j in range(n):
                own = mix(own * U(3) + hashes[begin[r] + j : begin[r] + j + 1], 1000 + j)
        else:
            own = np.zeros(0, U)
        out.append(own)
        bounds[r + 1] = bounds[r] + len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), bounds


def sequence_keys(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's word sequence, equal for equal sequences."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = (np.arange(len(hashes)) - begin[rows]).astype(U) if len(rows) else np.zeros(0, U)
    keys = []
    for seed in (11, 12):
        each = np.concatenate([[U(0)], np.cumsum(mix(hashes + place * U(0xA24BAED4963EE407), seed), dtype=U)])
        keys.append(mix(each[begin[1:]] - each[begin[:-1]] + counts.astype(U), seed + 2))
    return keys[0], keys[1]
