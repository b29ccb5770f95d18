"""Hashes of word shingles for whole batches of texts, with numpy inside a task."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# A-Z in lower case; ASCII punctuation and control characters separate words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else
               c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of non-ASCII characters."""
    return text.translate(_TABLE).split()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        tables = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers, _inverses = tables
    return _powers[:n], _inverses[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Shingles of ``size`` words of several texts, each a list of words.

    ``hashes`` holds them text by text, ``bounds`` where each text's begin, and ``string(i)`` the
    i-th itself. A text with fewer words is one shingle, one without words has none.
    """

    def __init__(self, texts: list[list[bytes]], size: int):
        self.buffer = b" ".join([b" ".join(w) for w in texts if w])
        counts = np.array([len(w) for w in texts], np.int64)
        lengths = np.fromiter((len(x) for w in texts for x in w), np.int64, int(counts.sum()))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        taken = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
        self.bounds = np.concatenate(([0], np.cumsum(taken)))
        owner = np.repeat(np.arange(len(texts)), taken)
        first_word = np.cumsum(counts) - counts
        first = np.arange(len(owner)) - self.bounds[owner] + first_word[owner]
        last = first + np.minimum(counts, size)[owner] - 1
        self.starts, self.ends = starts[first], ends[last]
        data = np.frombuffer(self.buffer, np.uint8).astype(np.uint64) + np.uint64(1)
        powers, inverses = _power_tables(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * powers[:-1], out=prefix[1:])
        self.hashes = mixed((prefix[self.ends] - prefix[self.starts]) * inverses[self.starts])

    def string(self, i: int) -> str:
        return self.buffer[self.starts[i]:self.ends[i]].decode("utf-8", "replace")


def groups(sizes: list[int], limit: int = 1 << 21) -> list[tuple[int, int]]:
    """Runs (from, to) of neighbouring items whose sizes add up to about ``limit`` at most."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out
