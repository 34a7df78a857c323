"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are maximal runs of characters other than space and U+0009 to U+000D,
lower-cased for A-Z only.  Both rules are exact on UTF-8 bytes, because every
byte of a longer character is above 0x7F.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser on an array of uint64."""
    x = (x + U(0x9E3779B97F4A7C15)) & U(_MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=256)
def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants, the same on every machine."""
    return splitmix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95) + U(seed)) | U(1)


_BYTE = constants(256, 11).copy()
_BASE = 0xF1357AEA2E62A9C5
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64)
        table = np.full(size, U(_BASE), dtype=U)
        table[0] = U(1)
        _powers = np.multiply.accumulate(table)
    return _powers


def hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end byte of each word of ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(raw)]))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=U), start, end
    length = end - start
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(at[-1] + length[-1], dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    terms = _BYTE[raw[inside]] * _power_table(int(length.max()))[place]
    return splitmix(np.add.reduceat(terms, at) + length.astype(U) * U(0xA0761D6478BD642F)), start, end


def chunks(texts: list, limit: int = 1 << 18) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Runs of texts of about ``limit`` bytes: first, last, joined bytes, byte offset of each text."""
    first, parts, offsets, size = 0, [], [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "replace")
        if parts and size + len(data) > limit:
            yield first, i, b"\n".join(parts), offsets
            first, parts, offsets, size = i, [], [], 0
        offsets.append(size)
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield first, len(texts), b"\n".join(parts), offsets


def hash_chunks(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's index, all word hashes, and where each text's words start (and the last end)."""
    for first, _, data, offsets in chunks(texts):
        hashes, start, _ = hash_long(data)
        yield first, hashes, np.concatenate((np.searchsorted(start, np.array(offsets, dtype=np.int64)), [len(hashes)]))


def hash_texts(texts: list) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; None counts as empty."""
    for _, hashes, cut in hash_chunks(texts):
        for i in range(len(cut) - 1):
            yield hashes[cut[i] : cut[i + 1]]


def hash_long(data: bytes, piece: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash_bytes`` in pieces cut between words, so that memory stays a small multiple of the text."""
    if len(data) <= piece:
        return hash_bytes(data)
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + piece)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        h, s, e = hash_bytes(data[at:to])
        out.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words; the whole sequence as one if there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    weight = constants(width, 977 * width)
    total = np.zeros(n - width + 1, dtype=U)
    for j in range(width):
        total += words[j : n - width + 1 + j] * weight[j]
    return splitmix(total)


_INVERSE = pow(_BASE, -1, 1 << 64)
_inverse_powers = np.ones(1, dtype=U)


class Runs:
    """Hashes of runs of words by a rolling polynomial modulo 2**64.

    Prefix sums of words times powers of the base's inverse make every width
    cost the same.
    """

    def __init__(self, words: np.ndarray) -> None:
        global _inverse_powers
        n = len(words)
        if len(_inverse_powers) < n:
            table = np.full(max(n, 1 << 16), U(_INVERSE), dtype=U)
            table[0] = U(1)
            _inverse_powers = np.multiply.accumulate(table)
        self.sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(words * _inverse_powers[:n], dtype=U)))
        self.powers = _power_table(n + 1)

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        """The hashes of the ``width`` words at each place; places without as many give anything."""
        low = np.clip(places, 0, max(len(self.sums) - 1 - width, 0))
        high = np.minimum(low + width, len(self.sums) - 1)
        return splitmix((self.sums[high] - self.sums[low]) * self.powers[low] + U(width))
