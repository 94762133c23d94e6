"""Sums over the sliding windows of many starts at once, for templates that scale with a power of frequency.

A template exp(-a lf) is a smooth function of a, so a window's sums at a few
Chebyshev nodes of a give them for every a.  Windows of a block of starts have a
row in common: each sum is one of the rows before it and one of the rows from
it on, so no sum is a difference of larger ones and the cost does not grow with
the rows in a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

#: rows whose log frequencies are within so much of a centre share a set of nodes
HALF_BAND = 1.5


def nodes_for(z: float, tol: float) -> int:
    """Number of nodes that give exp(z x), x in [-1, 1], within ``tol`` of its least value."""
    k, rest = 1, 2.0 * math.exp(2.0 * z)
    while rest > tol:
        rest *= z / 2.0 / k
        k += 1
    return k


def cheb_nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in [-1, 1] and the matrix that turns values there into Chebyshev coefficients."""
    at = (np.arange(n) + 0.5) * (np.pi / n)
    turn = np.cos(np.outer(np.arange(n), at)) * (2.0 / n)
    turn[0] /= 2.0
    return np.cos(at), turn


class Powers:
    """exp(-a lf) of rows for all a of a range, by bands of log frequency; ``factor`` scales the exponent. lf None: always 1."""

    def __init__(self, lf: np.ndarray | None, low: float, high: float, *, factor: float = 1.0, tol: float = 1e-13):
        self.mid, self.half, self.bands = (low + high) / 2.0, (high - low) / 2.0, []
        if lf is None or not len(lf):
            self.bands.append((None, 0.0, None, None))
            return
        lf = factor * lf
        left = np.sort(lf)
        while len(left):
            inside = left[left <= left[0] + 2.0 * HALF_BAND * factor]
            centre, reach = (inside[0] + inside[-1]) / 2.0, (inside[-1] - inside[0]) / 2.0
            x, turn = cheb_nodes(nodes_for(self.half * reach, tol))
            rows = np.where((lf >= inside[0]) & (lf <= inside[-1]), lf - centre, np.nan)
            self.bands.append((rows, centre, self.mid + self.half * x, turn))
            left = left[len(inside) :]

    def size(self) -> int:
        """Nodes of all bands."""
        return 1 if self.bands[0][0] is None else sum(len(a) for _, _, a, _ in self.bands)

    def at_nodes(self, near: slice = slice(None)) -> np.ndarray:
        """(nodes of all bands, rows): the row's power at each node of its band, else 0."""
        if self.bands[0][0] is None:
            return np.ones((1, 1))
        return np.concatenate([np.nan_to_num(np.exp(-a[:, None] * rows[near])) for rows, _, a, _ in self.bands])

    def function(self, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The sums of starts as a function of a (one for each start), from those at the nodes (nodes of all bands, starts)."""
        if self.bands[0][0] is None:
            return lambda a: sums[0]
        parts, k = [], 0
        for _, centre, nodes, turn in self.bands:
            parts.append((centre, turn @ sums[k : k + len(nodes)]))
            k += len(nodes)
        shift = lambda a: (a - self.mid) / self.half if self.half else a - self.mid
        return lambda a: sum(np.exp(-a * c) * np.polynomial.chebyshev.chebval(shift(a), p, tensor=False) for c, p in parts)


def blocks(times: np.ndarray, longest: float, spans: list[tuple[np.ndarray, np.ndarray]], few: Callable[[int, int], bool] | None = None) -> Iterator[slice]:
    """Runs of starts no longer than ``longest`` in which all windows of each kind, rows first to end, have a row or a gap in common.

    Or of 128 starts, wherever they are, if ``few`` says so of the first and the end of the run.
    """
    i = 0
    while i < len(times):
        if few is not None and few(i, end := min(i + 128, len(times))):
            yield slice(i, end)
            i = end
            continue
        k = np.searchsorted(times, times[i] + longest, "right")
        for first, stop in spans:
            k = min(k, np.searchsorted(first, stop[i], "right"))
        k = max(int(k), i + 1)
        yield slice(i, k)
        i = k


def straddling(terms: np.ndarray, origin: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of terms (kinds, rows from ``origin`` on) over rows first to end of each start of a block."""
    p, last = int(first[-1]) - origin, int(end[-1]) - origin
    got = to_end(terms[:, :p], first - origin)
    got += from_start(terms[:, p:last], end - origin - p)
    return got


def to_end(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of terms (kinds, rows) from row ``first`` on."""
    return from_start(terms[:, ::-1], terms.shape[1] - first)


def from_start(terms: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of terms (kinds, rows) up to and without row ``end``."""
    sums = np.zeros((len(terms), terms.shape[1] + 1))
    np.cumsum(terms, axis=1, out=sums[:, 1:])
    return np.take(sums, end, axis=1)


def golden_max_all(f: Callable[[np.ndarray], np.ndarray], n: int, low: float, high: float, tol: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """``stats.golden_max`` of n functions at once."""
    ratio = (5.0**0.5 - 1.0) / 2.0
    lo, hi = np.full(n, float(low)), np.full(n, float(high))
    x1, x2 = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    y1, y2 = f(x1), f(x2)
    while rounds > 0 and high - low > tol:  # the range shrinks alike for all
        rounds -= 1
        low, high = low, low + ratio * (high - low)
        down = y1 > y2
        hi, lo = np.where(down, x2, hi), np.where(down, lo, x1)
        x = np.where(down, hi - ratio * (hi - lo), lo + ratio * (hi - lo))
        y = f(x)
        x1, x2, y1, y2 = np.where(down, x, x2), np.where(down, x1, x), np.where(down, y, y2), np.where(down, y1, y)
    first = y1 >= y2
    return np.where(first, x1, x2), np.where(first, y1, y2)
