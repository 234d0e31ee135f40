"""Numpy helpers on columns of text: words, word hashes, shingle hashes.

All work on UTF-8 bytes in chunks of about ``CHUNK`` bytes, so the working
memory of a task does not follow the size of its Arrow batches. One text is
never cut: a longer one makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

U64 = np.uint64
_M = 0x9E3779B97F4A7C15  # odd multiplier of the polynomial byte hash
_MINV = pow(_M, -1, 1 << 64)
_C = 0xD6E8FEB86659FD93  # odd multiplier that combines the words of a shingle
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case: digits, a-z, all beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z in lower case, all other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        have = np.empty(max(n, CHUNK + 4096), U64)
        have[0], m = 1, _M if kind == "up" else _MINV
        k = 1
        while k < len(have):  # doubles the known powers
            step = min(k, len(have) - k)
            have[k:k + step] = have[:step] * U64(int(have[k - 1]) * m % (1 << 64))
            k += step
        _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective), elementwise."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array without copying; null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    _, offs, data = arr.buffers()
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offsets = np.frombuffer(offs, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, at least one row each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """The words of some texts: byte ranges in ``data``; ``first[i]:first[i+1]`` are text i's."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U64)
        total = np.empty(len(self.data) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * _power("up", len(self.data)), out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power("down", len(self.data) + 1)[self.start])

    def get(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``; none reaches over a text's end."""
    base = int(offsets[0])
    data = data[base:int(offsets[-1])]
    offs = offsets - base
    if lower:
        data = LOWER[data]
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge[:-1]] = False
        after[edge[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offs))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position on, and whether they stay in the text."""
    n = len(hashes)
    out = np.zeros(n, U64)
    if n >= k:
        acc = hashes[k - 1:].copy()
        for j in range(k - 2, -1, -1):
            acc *= U64(_C)
            acc += hashes[j:n - k + 1 + j]
        out[:n - k + 1] = mix(acc)
    last = np.repeat(first[1:], np.diff(first))
    return out, np.arange(n) + k <= last


def fold(hashes: np.ndarray) -> np.uint64:
    """The same combination as ``shingles``, of all given words (at least one)."""
    return shingles(hashes, np.array([0, len(hashes)]), len(hashes))[0][0]
