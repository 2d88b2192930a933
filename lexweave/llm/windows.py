"""Hashes of character windows, by the batch.

With S[i] the sum of c[j] P^j over j < i, modulo 2^64 and P odd, a window's hash is (S[e] - S[s]) P^-s: the same wherever
the same characters stand, and a few array operations for any number of windows.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
#: About so many characters are hashed at once.
SUB_BATCH = 1_500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Texts one behind the other, a separator after each; ``offsets[i]`` is where text i begins."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes + np.uint64(1)) * _powers(P, len(codes)), dtype=np.uint64)])
            self.back = _powers(INVERSE, len(codes) + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.back[start]

    def every(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of k characters within a text, and the text each is of."""
        lengths = np.maximum(np.diff(self.offsets) - 1 - k + 1, 0)
        whose = np.repeat(np.arange(len(lengths)), lengths)
        before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        return self.offsets[whose] + np.arange(len(whose)) - before[whose], whose


def mixed(h: np.ndarray, group: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
    """The hash together with its group and kind."""
    with np.errstate(over="ignore"):
        return _mix(h + group * np.uint64(0xD1B54A32D192ED03) + np.asarray(kind).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def tally(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal hashes together, their two counts summed."""
    h = np.concatenate([p[0] for p in parts]).view(np.int64)
    a, b = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    if not len(h):
        return h, a, b
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(a[order], first), np.add.reduceat(b[order], first)
