"""Word shingles of texts as 64-bit hashes, in array form."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x100000001B3 * 2 + 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEPS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)]
_powers: list[np.ndarray] = []
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def prefix(a: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: prefix[i] covers a[:i]."""
    up, _ = powers(len(a))
    out = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + U(1)) * up[: len(a)], out=out[1:])
    return out


def shingles(texts: list[str], words: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct hashes in order, counts) of each text's runs of so many words.
    A text of fewer words, but one at least, is one shingle."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    if len(texts) == 0:
        return []
    space = SPACE[a]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    p = prefix(a)
    _, down = powers(len(a))
    w = mix((p[end] - p[start]) * down[start])
    first = np.cumsum([1] + [len(r) + 1 for r in raw])
    at = np.searchsorted(start, first)
    total = np.zeros(max(len(w) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        total += w[k : len(w) - words + 1 + k] * STEPS[k % 5] if len(total) else total
    total = mix(total)
    out = []
    for lo, hi in zip(at, at[1:]):
        if hi - lo >= words:
            out.append(np.unique(total[lo : hi - words + 1], return_counts=True))
        elif hi > lo:
            few = w[lo:hi] * np.array([STEPS[k % 5] for k in range(hi - lo)])
            out.append((mix(few.sum(keepdims=True) + U(hi - lo)), np.ones(1, dtype=np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard of two shingle bags; 0 if both are empty."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    return both / (int(x[1].sum()) + int(y[1].sum()) - both)
