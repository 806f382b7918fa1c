"""Vectorised word and shingle hashing of whole texts (numpy over the UTF-8 bytes of an Arrow batch)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = [U(int(x)) for x in np.random.default_rng(8).integers(1, 2**62, 16, dtype=np.uint64) * U(2) + U(1)]
_powers = [np.ones(1, U), np.ones(1, U)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse mod 2^64 to the powers 0..n-1 at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and each text's bounds in them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word (A-Z only) in reading order, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(bounds) - 1, np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    cut[0] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word shingle, text by text, and their number for each text; 1 to k-1 words make one shingle."""
    first = np.concatenate(([0], np.cumsum(counts)))
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(at[-1], U)
    n = len(words) - k + 1
    rolled = np.zeros(max(n, 0), U)
    for j in range(k if n > 0 else 0):
        rolled += words[j : j + n] * _PLACES[j]
    inside = np.repeat(counts >= k, number)
    where = np.repeat(first[:-1] - at[:-1], number) + np.arange(at[-1])
    out[inside] = rolled[where[inside]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[first[i] : first[i + 1]]
        out[at[i]] = np.sum(np.append(w * np.array(_PLACES[: len(w)], U), _PLACES[8 + len(w)]))
    return mix64(out), number


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    values, number = shingle_hashes(*word_hashes(*utf8(column)), k)
    out = []
    for part in np.split(values, np.cumsum(number)[:-1]) if len(number) else []:
        part = np.sort(part)
        out.append(part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) else part)
    return out
