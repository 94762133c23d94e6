"""Window sums of many starts at once, held against sums over each window."""

import time

import numpy as np
import pytest

from residua.functions.stats import golden_max
from residua.functions.windows import from_start, to_end
from residua.operators.bumps import SHAPES, chunk_bumps, shape_of
from residua.operators.dips import chunk_dips
from residua.operators.transients import chunk_starts
from residua.options import options


def rows(n, span, seed, size=3.0):
    rng = np.random.default_rng(seed)
    t = np.sort(50100 + rng.uniform(0, span, n))
    t[n // 2] = t[n // 2 + 1]
    f = rng.choice([300.0, 820.0, 1400.0, 2640.0, 4864.0], n) * (1 + rng.uniform(-0.02, 0.02, n))
    f[0], f[1] = 0.01, 99_999.0
    s = 10 ** rng.uniform(-7, -5, n)
    y = size * rng.normal(size=n) * s
    y[n // 5], s[n // 5] = 0.9, 1e-8  # dwarfs all others
    return t, y, 1 / s**2, f


@pytest.mark.parametrize("colour", [True, False])
def test_dips_of_many_starts(colour):
    t, y, w, f = rows(400, 300.0, 1)
    y -= 1e-5 * np.exp(-np.maximum(0, t - t[90]) / 30) * (1400 / f) ** 3 * (t >= t[90])
    own, cfg = np.floor(t / 150) == np.floor(t[0] / 150), options("dip", colour=colour)
    got = {i: rest for i, *rest in chunk_dips(t, y, w, f, own, cfg)}
    assert len(got) > 20
    for i in np.flatnonzero(own):
        k = (t >= t[i]) & (t <= t[i] + 150)

        def gain(a):
            m = np.exp(-(t[k] - t[i]) / 30) * f[k] ** -a
            num, den = w[k] * m @ y[k], w[k] * m @ m
            return num * num / den if num < 0 else -np.inf

        alpha, best = golden_max(gain, 2.0, 4.0, 1e-3, 64) if colour else (0.0, gain(0.0))
        assert (i in got) == (best >= 25)
        if i in got:
            assert got[i][2] == pytest.approx(best, rel=1e-9) and (not colour or got[i][1] == pytest.approx(alpha, abs=1e-6))


def test_dips_of_dense_rows():
    """20,000 rows in two windows' lengths: a search over the rows of each window took half a minute."""
    t, y, w, f = rows(20_000, 300.0, 2)
    y -= 1e-5 * np.exp(-np.maximum(0, t - t[900]) / 30) * (1400 / f) ** 3 * (t >= t[900])
    began = time.process_time()
    assert chunk_dips(t, y, w, f, np.floor(t / 150) == np.floor(t[0] / 150), options("dip"))
    assert time.process_time() - began < 5


@pytest.mark.parametrize("colour", [True, False])
@pytest.mark.parametrize("n", [200, 900])
def test_bumps_of_many_starts(n, colour):
    t, y, w, f = rows(n, 900.0, 3)
    y += 1e-5 * np.exp(-0.5 * ((t - t[n // 2]) / 50) ** 2) * (1400 / f) ** 2
    own, cfg, lf = np.floor((t - t[0]) / 300) == 1, options("bump", colour=colour), np.log(f / np.median(f))
    got = {i: rest for i, *rest in chunk_bumps(t, y, w, lf if colour else None, own, 300.0, cfg)}
    assert len(got) > 20
    for i in np.flatnonzero(own)[::3]:
        k = np.flatnonzero((t >= t[i] - 150) & (t <= t[i] + 150))
        found = {}
        for kind in SHAPES:
            base = shape_of(kind, np.abs(t[k] - t[i]), 300.0)

            def gain(a):
                m = base * np.exp(-a * lf[k])
                return (w[k] * m @ y[k]) ** 2 / (w[k] * m @ m)

            found[kind] = golden_max(gain, 0.0, 4.0, 1e-3, 64)[1] if colour else gain(0.0)
        best = max(found, key=found.get)
        assert (i in got) == (found[best] >= 25 and len(k) >= 20)
        if i in got:
            assert got[i][0] == best and got[i][3] == pytest.approx(found[best], rel=1e-9)


def test_bumps_of_dense_rows():
    """13,000 starts with 13,000 rows each: a search over the rows of each window took seconds without a frequency dependence and minutes with one."""
    t, y, w, f = rows(40_000, 4500.0, 5)
    own, began = np.floor((t - t[0]) / 1500) == 1, time.process_time()
    assert chunk_bumps(t, y, w, None, own, 1500.0, options("bump", colour=False))
    assert time.process_time() - began < 2


def test_bumps_with_frequency_of_dense_rows():
    t, y, w, f = rows(20_000, 4500.0, 5)
    own, began = np.floor((t - t[0]) / 1500) == 1, time.process_time()
    assert chunk_bumps(t, y, w, np.log(f / 1400), own, 1500.0, options("bump"))
    assert time.process_time() - began < 8


def test_transient_windows():
    t, y, w, _ = rows(300, 400.0, 7)
    own = np.floor(t / 35) < np.floor(t[-1] / 35) - 1
    got = {i: rest for i, *rest in zip(*chunk_starts(t, y, w, own, 7.0, 35.0))}
    assert sorted(got) == np.flatnonzero(own).tolist()
    for i, (amp, delta, n, last) in got.items():
        k = (t >= t[i]) & (t <= t[i] + 35)
        f = np.exp(-(t[k] - t[i]) / 7)
        num, den = w[k] * f @ y[k], w[k] * f @ f
        assert (n, last) == (k.sum(), t[k][-1]) and amp == pytest.approx(num / den, rel=1e-9) and delta == pytest.approx(num * num / den, rel=1e-9)


def test_sums_from_either_end():
    x, k = np.random.default_rng(8).normal(size=(3, 7)), np.array([0, 2, 2, 7])
    for i, want in enumerate(k):
        assert to_end(x, k)[:, i] == pytest.approx(x[:, want:].sum(axis=1)) and from_start(x, k)[:, i] == pytest.approx(x[:, :want].sum(axis=1))
