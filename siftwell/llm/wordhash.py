"""64-bit hashes of words and of runs of words, for many texts at once in numpy.

A word's hash is a polynomial over a random value for each of its bytes, mixed; a run's
is a polynomial over its words' hashes, mixed.  All are taken from running sums, so no
word is ever made a Python object.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _RUN = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes hashed at once, so that the arrays stay small; one longer text comes alone.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def other_lane(x: np.ndarray) -> np.ndarray:
    """A second hash of hashed words, for keys of 128 bits: sums of it are independent of sums
    of the first."""
    return mix(x ^ np.uint64(0x8CB92BA72F3D8DD7)) ^ (x >> np.uint64(17))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _tables[base] = tuple(both)
        if size > 8 * CHUNK:  # not kept after one huge text
            del _tables[base]
    return have


def _sums(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def word_hashes(body: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (split at space and \\t..\\r) of the texts that `body` holds
    end to end, and the number of words of each text."""
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    gap = _SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[0] = True
    edge[ends] = True
    before = np.concatenate(([True], gap)) | edge  # nothing of a word goes on over this place
    starts = np.flatnonzero(~gap & before[:-1])
    stops = np.flatnonzero(~np.concatenate(([True], gap)) & (np.concatenate((gap, [True])) | edge))
    with np.errstate(over="ignore"):
        sums, down = _sums(_BYTE[_LOWER[body] if lower else body], _BASE)
        hashed = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    counts = np.searchsorted(starts, ends)
    return hashed, np.diff(np.concatenate(([0], counts)))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on (also over the texts' bounds)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums, down = _sums(words, _RUN)
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def chunks(at: np.ndarray, most: int = CHUNK, row: int = 0):
    """Row ranges (a, b) that hold about `most` bytes, each row counting `row` more;
    `at`: where rows start and end."""
    group = (at[1:] - at[0] + row * np.arange(len(at) - 1)) // most
    edges = (np.flatnonzero(np.diff(group)) + 1).tolist()
    yield from zip([0, *edges], [*edges, len(at) - 1], strict=True)
