"""Word-shingle sets of texts, vectorised: A-Z lower-cased, words are runs without ASCII white space."""

from __future__ import annotations

import numpy as np

_SPACE = [9, 10, 11, 12, 13, 32]
_VALUE = np.arange(1, 257, dtype=np.uint64)  # of a byte in a word; 0 for white space
_VALUE[65:91] += 32
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_PLACES = tuple(np.uint64(x) for x in (_BASE, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
BLOCK_BYTES = 1 << 21
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (multiplications wrap)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _tables.append(np.multiply.accumulate(table))
    return _tables


def _word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of the words of a buffer that ends with white space: differences of a running sum of
    value * base^place, divided by the power at the word's first byte."""
    values = _VALUE[buffer]
    inside = np.concatenate([[False], values != 0])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    forward, inverse = powers(len(buffer))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), values * forward[: len(values)]])
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + mix((ends - starts).astype(np.uint64))), starts, ends


def words_in(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of all words of a buffer of UTF-8 that ends with white space."""
    found, at = [], 0
    while at < len(buffer):
        end = min(at + BLOCK_BYTES, len(buffer))
        while buffer[end - 1] not in _SPACE:
            end += 1
        own, first, last = _word_hashes(buffer[at:end])
        found.append((own, first + at, last + at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return hashes, starts, ends


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words end among them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes, starts, _ = words_in(np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8))
    return hashes, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))


def sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    if not texts:
        return []
    hashes, ends = word_hashes([t or "" for t in texts])
    n = len(hashes)
    grams = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k if n >= k else 0):
        grams += hashes[j : n - k + 1 + j] * _PLACES[j]
    grams = mix(grams)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= k:
            own = np.sort(grams[start : end - k + 1])
            again = own[1:] == own[:-1]
            out.append(own[np.concatenate([[True], ~again])] if again.any() else own)
        elif end > start:
            whole = np.uint64(end - start)
            for h in hashes[start:end]:
                whole = mix(np.array([whole]) + h)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start = end
    return out


def chunks(items: list, size, most: int):
    """Consecutive slices of items whose sizes add up to about `most`."""
    own, total = [], 0
    for x in items:
        own.append(x)
        total += size(x)
        if total >= most:
            yield own
            own, total = [], 0
    if own:
        yield own
