"""Hashes of byte ranges over a batch of texts, in numpy."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BATCH_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _base(seed: int) -> tuple[np.ndarray, int, int]:
    """A random value per byte, an odd base and its inverse modulo 2**64."""
    values = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1)) * GOLDEN)
    base = int(mixed(np.array([seed + 77], np.uint64) * GOLDEN)[0]) & ~7 | 5
    return values, base, pow(base, -1, 1 << 64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, seed: int, inverse: bool) -> np.ndarray:
    known = _POWERS.get((seed, inverse))
    if known is None or len(known) < n:
        size = -(-n // (1 << 18)) * (1 << 18)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 2 * BATCH_BYTES:
            _POWERS[(seed, inverse)] = known
    return known[:n]


class RangeHash:
    """Hashes of any byte range of a buffer: prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buffer: np.ndarray, seed: int = 1):
        values, base, inverse = _base(seed)
        n = len(buffer) + 1
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(values[buffer] * _powers(base, n, seed, False)[: n - 1], out=self.prefix[1:])
        self.back = _powers(inverse, n, seed, True)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        width = (end - start).astype(np.uint64)
        return mixed((self.prefix[end] - self.prefix[start]) * self.back[start] + width * GOLDEN)


def joined(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, a space after each; where each text starts and ends."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(texts) else ends
    return (_LOWER[buffer] if lower else buffer), starts.astype(np.int64), ends


def words_of(buffer: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the index of each word's text."""
    space = _IS_SPACE[buffer]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends, np.searchsorted(text_starts, starts, side="right") - 1


def in_batches(sizes: np.ndarray, limit: int = BATCH_BYTES):
    """Slices of consecutive items of ``limit`` bytes together; a larger item stands alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if len(sizes) > begin:
        yield begin, len(sizes)


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
