"""Hashes of a text's words and characters, for whole arrays at a time."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = U64(pow(int(MULTIPLIER), -1, 1 << 64))
#: bytes of [\x20\x09-\x0D]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A-Z in lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U64))
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**i and INVERSE**i for i below ``n``."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        step = np.full(n, MULTIPLIER)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step = np.full(n, INVERSE)
        step[0] = 1
        _inverses = np.multiply.accumulate(step)
    return _powers, _inverses


def run_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of non-blank bytes in ``data``, in order."""
    if not len(data):
        return np.zeros(0, U64)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_HASH[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, in order. Equal words, equal hashes."""
    return run_hashes(LOWER[np.frombuffer((text or "").encode(), np.uint8)])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; fewer words, but some, are one shingle."""
    n = len(words)
    if not n:
        return words
    wide = min(width, n)
    out = np.full(n - wide + 1, U64(wide))
    for k in range(wide):
        out = mix(out + words[k : n - wide + 1 + k])
    return np.unique(out)
