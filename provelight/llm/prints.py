"""Fingerprints of stretches of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters of one block of texts that are worked on together.
BLOCK = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a base; those of ordinary blocks are kept."""
    return _powers(base, 2 * BLOCK)[:n] if n <= 2 * BLOCK else _powers.__wrapped__(base, n)


@lru_cache(maxsize=8)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and offsets of the texts (one more than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def blocks(batches: Iterator, text_at: int = 1) -> Iterator[list[tuple]]:
    """The rows of Arrow batches in lists of about ``BLOCK`` characters; ``text_at`` is the column of the text."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            size += len(row[text_at])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


class Windows:
    """128-bit fingerprints of stretches of a block, in constant time each."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        value = mix(codes.astype(np.uint64) + np.uint64(0x1234567))
        self.sums, self.back = [], []
        for base in ODD:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(value * powers(base, n), dtype=np.uint64, out=sums[1:])
            self.sums.append(sums)
            self.back.append(powers(np.uint64(pow(int(base), -1, 1 << 64)), n))

    def prints(self, at: np.ndarray, length: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of the fingerprint of each stretch of ``length`` characters from ``at``."""
        out = []
        for sums, back in zip(self.sums, self.back, strict=True):
            h = (sums[at + length] - sums[at]) * back[at]
            out.append(mix(h).view(np.int64))
        return out[0], out[1]

    def rolling(self, length: int) -> np.ndarray:
        """One half for every stretch of ``length`` characters of the block."""
        sums, back = self.sums[0], self.back[0]
        n = max(0, len(sums) - length)
        return mix((sums[length : length + n] - sums[:n]) * back[:n])
