"""Array kernels of the byte-level context-tree-weighting model.

A text is coded as its words, each followed by a space, then one newline; A-Z
are lowered first. Every byte is eight binary decisions. The context of a
decision is the last ``d`` bytes plus the bits of the current byte already
coded, for every ``d`` from 0 to ``depth``. Each context node holds a
Krichevsky-Trofimov estimate; a node mixes its own estimate with that of its
longer child, weighted by the posterior that context-tree weighting gives on
the training data. A child that training never visited hands over to its
parent, so the mixture stays a proper distribution over the next byte.

A code holds a byte and its context: the latest context byte is highest, the
byte itself lowest, and between them unused bytes are zero for shorter contexts.
So codes in order have the contexts that share their latest bytes together.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
END = 10


def tokens(text: str | None) -> list[bytes]:
    """Words of a text after lowering A-Z; bytes.split() cuts at 0x20 and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def coded(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" \n" if words else b"\n"


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5: shifted Stirling series."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        small = z < 8
        if not small.any():
            break
        shift = np.where(small, shift - np.log(z), shift)
        z = np.where(small, z + 1, z)
    i = 1 / z
    i2 = i * i
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))


_half, _whole = lgamma(np.arange(4096) + 0.5), lgamma(np.arange(8192) + 1.0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the sequential KT probability of n0 zeros and n1 ones; small counts come from a table."""
    n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
    few = (n0 < len(_half)) & (n1 < len(_half))
    out = np.empty(len(n0))
    a, b = n0[few], n1[few]
    out[few] = _half[a] + _half[b] - _whole[a + b]
    a, b = n0[~few].astype(np.float64), n1[~few].astype(np.float64)
    out[~few] = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0)
    return out - math.log(math.pi)


def grams(seqs: list[bytes], depth: int) -> np.ndarray:
    """Codes, one for each byte of each sequence; positions before a sequence count as newlines."""
    pad = bytes([END]) * depth
    a = np.frombuffer(pad + pad.join(seqs), dtype=np.uint8).astype(U)
    code = a[depth:].copy()
    for d in range(1, depth + 1):
        code |= a[depth - d : len(a) - d] << U(8 * (depth + 1 - d))
    lens = np.fromiter((len(s) for s in seqs), dtype=np.int64, count=len(seqs))
    if depth and len(seqs) > 1:  # drop the codes that end in padding
        keep = np.ones(len(code), dtype=bool)
        at = np.cumsum(lens[:-1] + depth) - depth
        for k in range(depth):
            keep[at + k] = False
        code = code[keep]
    return code


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with each value summed."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")  # mostly sorted runs
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return (k[first], *(np.add.reduceat(v[order], first) for v in values))


def shorter(code: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Codes of depth ``depth`` as codes of depth ``to``: the oldest bytes go."""
    drop = U(8 * (depth - to))
    return (code >> (drop + U(8)) << U(8)) | (code & U(255))


class Level:
    """The binary nodes of one depth, over its distinct codes in order. Node j of
    bit k holds the codes that share the context and the first k bits."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        self.code, self.count = code, count
        self.of, self.first, self.n0, self.n1 = [], [], [], []  # by bit: node of each code, first code of each node, zeros, ones
        prefix = (code >> U(8) << U(8), code & U(255))
        for k in range(8):
            key = prefix[0] | (prefix[1] >> U(8 - k))
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            one = np.where((prefix[1] >> U(7 - k)) & U(1), count, 0)
            self.of.append((np.cumsum(new) - 1).astype(np.int32))
            self.first.append(first)
            n = np.add.reduceat(count, first) if len(first) else count
            n1 = np.add.reduceat(one, first) if len(first) else one
            self.n0.append(n - n1)
            self.n1.append(n1)
        self.lw: list[np.ndarray] = []
        self.w: list[np.ndarray] = []

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """below: by bit, the log weighted probabilities of each node's children, summed; None at the deepest level."""
        for k in range(8):
            own = log_kt(self.n0[k], self.n1[k])
            if below is None:
                self.lw.append(own)
                self.w.append(np.ones(len(own)))
            else:
                lw = np.logaddexp(own, below[k]) - math.log(2)
                self.lw.append(lw)
                self.w.append(np.exp(np.minimum(0.0, own - math.log(2) - lw)))

    def mix(self, state: list["State"]) -> None:
        """Takes this depth's nodes into the mixtures of its codes, one state for each bit."""
        for k, x in enumerate(state):
            n = self.n0[k] + self.n1[k]
            x.add((n > 0)[self.of[k]], ((self.n1[k] + 0.5) / (n + 1.0))[self.of[k]], self.w[k][self.of[k]])


class State:
    """Of some codes, for one bit: the mixture so far, the weight that is left, and the deepest node's estimate."""

    def __init__(self, n: int):
        self.p, self.rest, self.last, self.live = np.zeros(n), np.ones(n), np.full(n, 0.5), np.ones(n, dtype=bool)

    def add(self, met: np.ndarray, own: np.ndarray, w: np.ndarray) -> None:
        """A child that training never visited leaves all to its parent."""
        self.live &= met
        w = np.where(self.live, w, 0.0)
        self.last = np.where(self.live, own, self.last)
        self.p += self.rest * w * own
        self.rest *= 1 - w

    def take(self, at: np.ndarray) -> None:
        self.p, self.rest, self.last, self.live = self.p[at], self.rest[at], self.last[at], self.live[at]


def tree(code: np.ndarray, count: np.ndarray, depth: int, top: int) -> tuple[list[Level], list[np.ndarray]]:
    """Weighed levels of depths top..depth (in this order), and the index of each
    level's codes in the level above (the first list entry is of level top + 1).
    code: distinct, in order. Codes with a count of 0 take part without a vote."""
    levels, up = [Level(code, count)], []
    for d in range(depth, top, -1):
        low = levels[0]
        short = shorter(low.code, d, d - 1)
        order = np.argsort(short)
        k = short[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        inv = np.empty(len(k), dtype=np.int64)
        inv[order] = np.cumsum(new) - 1
        levels.insert(0, Level(k[first], np.add.reduceat(low.count[order], first) if len(first) else low.count))
        up.insert(0, inv)
    for i in range(len(levels) - 1, -1, -1):
        if i == len(levels) - 1:
            levels[i].weigh(None)
            continue
        below, here, inv = levels[i + 1], levels[i], up[i]
        sums = []
        for k in range(8):
            to = here.of[k][inv[below.first[k]]]
            sums.append(np.bincount(to, weights=below.lw[k], minlength=len(here.first[k])))
        here.weigh(sums)
    return levels, up


def top_index(code: np.ndarray, k: int) -> np.ndarray:
    """Key of a code's node of bit k: its context, then 1 and the first k bits."""
    return (((code >> U(8)) << U(8)) | U(1 << k) | ((code & U(255)) >> U(8 - k))).astype(np.int64)


def mixture(code: np.ndarray, depth: int, tops: list[tuple[np.ndarray, np.ndarray, np.ndarray]], levels: list[Level], up: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of the last byte of each of the deepest level's codes.

    tops[d], for the depths above the levels: sorted node keys, probability of a
    one, own weight. levels and up as tree() gives them. Mixtures are worked out
    from the shallowest depth down, each over the distinct codes of its depth."""
    low, here = depth + 1 - len(levels), levels[0].code
    if tops:
        short, at = np.unique(shorter(here, low, low - 1), return_inverse=True)
    else:
        short, at = here, np.arange(len(here))
    state = [State(len(short)) for _ in range(8)]
    for k, x in enumerate(state):
        for d, (keys, p1, w) in enumerate(tops):
            if not len(keys):
                x.live[:] = False
                continue
            key = top_index(shorter(short, low - 1, d), k).astype(U)
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            x.add(keys[i] == key, p1[i], w[i])
    for level, i in zip(levels, [at, *up]):
        for x in state:
            x.take(i)
        level.mix(state)
    total = np.zeros(len(code))
    for k, x in enumerate(state):
        p = x.p + x.rest * x.last  # what is left goes to the deepest node seen
        total += np.log10(np.where((code >> U(7 - k)) & U(1), p, 1 - p))
    return total
