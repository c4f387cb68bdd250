"""Array kernels over whole batches of texts: token cutting, rolling hashes, minimizers. No Spark here.

Hashes are polynomials modulo 2^64 over mixed symbols, finished by a bijective mixer. Windows of at most a few hundred
symbols can't run into the known structured collisions of that modulus, which need thousands. Every seed is fixed, so
all tasks agree.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_table = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) % 2**64
    return x


INVERSE = U(_inverse(int(BASE)))


_kept: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those computed before are kept, up to a million."""
    had = _kept.get(int(base))
    if had is not None and len(had) >= n:
        return had[:n]
    made = _powers(base, max(n, 4096))
    if len(made) <= 1 << 20:
        _kept[int(base)] = made
    return made[:n]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(int(base), done, 2**64))
            done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (splitmix finisher)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Hashes of any run of ``symbols`` (64-bit words), each in constant time."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.back = powers(INVERSE, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(symbols * powers(BASE, n), out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def all_windows(self, k: int) -> np.ndarray:
        """As ``windows``, the last one included."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.back[:n]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _table[data]


def argmins(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` consecutive hashes, the place of its (rightmost) smallest."""
    n = len(hashes)
    if n < w or w < 1:
        return np.empty(0, np.int64)
    if w == 1:
        return np.arange(n)
    # Keep the place in the low bits: one minimum gives both, and equal hashes prefer the later place.
    pad = -n % w
    mask = U((1 << 32) - 1)
    keyed = np.concatenate([(hashes & ~mask) | (mask - np.arange(n, dtype=np.uint64)), np.full(pad, ~U(0), np.uint64)])
    blocks = keyed.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (mask - (least & mask)).astype(np.int64)


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places that are the smallest of some ``w`` consecutive hashes, ascending."""
    at = argmins(hashes, w)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def minimizer_runs(hashes: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same places, with the first and last of the runs each is the smallest of."""
    at = argmins(hashes, w)
    if not len(at):
        return at, at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], len(at)) - 1


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 data."""
    word = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def token_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word."""
    raw = np.frombuffer(data, np.uint8)
    start, end = token_bounds(raw)
    if not len(start):
        return np.empty(0, np.uint64)
    return mix(Rolling(byte_symbols(raw)).runs(start, end) ^ (end - start).astype(np.uint64))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
