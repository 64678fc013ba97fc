"""Hashes of words and word sequences, for many texts at once in numpy.

Words are maximal runs of bytes other than space and \\x09-\\x0D. A polynomial prefix hash over the bytes (odd base, modulo 2**64,
random byte values) gives each word's hash whatever its place; sequences combine their words' mixed hashes.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(5)
_VALUE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd, for sequences.
STEP = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, n - 1).bit_length()
        have = np.full(size, base & (2**64 - 1), np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose values are summed at once; with one very long text, arrays of eight bytes for each of its bytes would be what a task holds.
BLOCK = 1 << 18


def _word_sums(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each word the sum of its bytes' values times powers that begin at the word: differences of prefix sums, block by block."""
    out, carry = np.zeros(len(start), np.uint64), np.uint64(0)
    base, inverse = powers(_BASE, BLOCK), powers(_INVERSE, BLOCK)
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = carry
        values = _VALUE[part]
        values *= base[: len(part)]
        values *= np.uint64(pow(_BASE, at, 1 << 64))
        np.cumsum(values, out=sums[1:], dtype=np.uint64)
        sums[1:] += carry
        carry = sums[-1]
        # Ends first: a word that begins in this block may end in a later one.
        a, b = np.searchsorted(stop, [at + 1, at + len(part) + 1])
        out[a:b] += sums[stop[a:b] - at]
        a, b = np.searchsorted(start, [at, at + len(part)])
        out[a:b] -= sums[start[a:b] - at]
    for at in range(0, len(raw), BLOCK):
        a, b = np.searchsorted(start, [at, at + BLOCK])
        out[a:b] *= inverse[start[a:b] - at] * np.uint64(pow(_INVERSE, at, 1 << 64))
    return out


class Words:
    """Word hashes of texts. Text i has hashes[first[i]:first[i + 1]]; begin and end are byte offsets in text i."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, stop = edge[::2], edge[1::2]
        self.hashes = mix(_word_sums(raw, start, stop))
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(start, base)
        own = np.repeat(base[:-1], np.diff(self.first))
        self.begin, self.end = start - own, stop - own

    def sequences(self, n: int, step: int = STEP) -> np.ndarray:
        """At each word, the hash of the n words from there; those that run past a text's end mean nothing."""
        h = self.hashes
        if len(h) < n:
            return np.empty(0, np.uint64)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(step, len(h)), out=sums[1:], dtype=np.uint64)
        return mix((sums[n:] - sums[:-n]) * powers(pow(step, -1, 1 << 64), len(h) + 1)[: len(h) - n + 1])


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of fewer words, the hash of all; of none, nothing."""
    words = Words(texts)
    every, first, out = words.sequences(n), words.first.tolist(), []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(every[a : b - n + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                total = (words.hashes[a:b] * powers(STEP, b - a)).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([total ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
