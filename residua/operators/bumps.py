"""Symmetric bumps of several durations and shapes, optionally scaling with a power of frequency."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.functions.windows import Powers, blocks, cheb_nodes, from_start, golden_max_all, nodes_for, straddling, to_end
from residua.operators.blocks import small

SHAPES = ("gaussian", "laplace", "plateau")


def shape_of(kind: str, d: np.ndarray, length: float) -> np.ndarray:
    """Template over the distance d from the centre: width length/6, or a flat top of length/3 with shoulders of length/10."""
    if kind == "gaussian":
        return np.exp(-0.5 * (d / (length / 6.0)) ** 2)
    if kind == "laplace":
        return np.exp(-d / (length / 6.0))
    return np.exp(-np.maximum(0.0, d - length / 6.0) / (length / 10.0))


def shape_sums(t: np.ndarray, terms: tuple[np.ndarray, np.ndarray], t0: np.ndarray, length: float, tol: float) -> list[list[np.ndarray]]:
    """For each shape, sums of terms[0] * template and of terms[1] * template^2 (nodes, starts) over the window of each start.

    Exponentials split into a factor of the row and one of the start.  That of
    a gaussian is interpolated in the start between Chebyshev nodes of a block.
    """
    half, flat, s = length / 2.0, length / 6.0, length / 6.0
    find = lambda d, side: np.searchsorted(t, t0 + d, side)
    a, b, m, e, z = find(-half, "left"), find(-flat, "left"), find(0.0, "left"), find(flat, "right"), find(half, "right")
    out = [[np.empty((len(x), len(t0))) for x in terms] for _ in SHAPES]
    few = 40_000  # where pairs of start and row cost less than nodes
    for k in blocks(t0, length / 3.0, [(a, m), (m, z), (a, b), (b, e), (e, z)], lambda i, j: (j - i) * (z[j - 1] - a[i]) <= few):
        at, near = t0[k], slice(a[k][0], z[k][-1])
        n_starts = len(at)
        if n_starts * (near.stop - near.start) <= few:
            d = np.abs(t[near] - at[:, None])
            inside = (np.arange(near.start, near.stop) >= a[k][:, None]) & (np.arange(near.start, near.stop) < z[k][:, None])
            for i, kind in enumerate(SHAPES):
                f = np.where(inside, shape_of(kind, d, length), 0.0)
                out[i][0][:, k], out[i][1][:, k] = terms[0][:, near] @ f.T, terms[1][:, near] @ (f * f).T
            continue
        c = (at[0] + at[-1]) / 2.0

        def part(power: int, first: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
            """Sums with the template exp(rate * (t - t0))."""
            first, end = first[k], end[k]
            rows = slice(first[0], end[-1])
            return straddling(terms[power - 1][:, rows] * np.exp(power * rate * (t[rows] - c)), first[0], first, end) * np.exp(power * rate * (c - at))

        reach, u, x = (at[-1] - at[0]) / 2.0 / s, (t[near] - c) / s, (at - c) / s
        for power in (1, 2):
            nodes, turn = cheb_nodes(nodes_for(power * reach * max(-u[0], u[-1]), tol))
            share = (np.polynomial.chebyshev.chebvander(x / reach if reach else x, len(nodes) - 1) @ turn).T * np.exp(-0.5 * power * x * x)
            at_nodes = np.exp(power * u * (reach * nodes[:, None] - 0.5 * u))
            # rows of all windows are summed once, those of some as they come and go
            i, j = a[k][-1] - near.start, z[k][0] - near.start
            mine = terms[power - 1][:, near]
            got = (mine[:, i:j] @ at_nodes[:, i:j].T) @ share
            for f, part_of in zip(at_nodes, share):
                got += (to_end(mine[:, :i] * f[:i], a[k] - near.start) + from_start(mine[:, j:] * f[j:], z[k] - z[k][0])) * part_of
            out[0][power - 1][:, k] = got
            out[1][power - 1][:, k] = part(power, a, m, 1.0 / s) + part(power, m, z, -1.0 / s)
            shoulders = part(power, a, b, 10.0 / length) + part(power, e, z, -10.0 / length)
            out[2][power - 1][:, k] = shoulders * np.exp(power * 10.0 / 6.0) + part(power, b, e, 0.0)
    return out


def chunk_bumps(t: np.ndarray, y: np.ndarray, w: np.ndarray, lf: np.ndarray | None, own: np.ndarray, length: float, cfg: Options) -> list[tuple]:
    """(row, shape, amplitude, alpha, delta_chi2) of own rows with an accepted bump of this length; rows sorted by time.

    All starts are searched at once, on window sums.
    """
    start, stop = np.searchsorted(t, t - length / 2.0, "left"), np.searchsorted(t, t + length / 2.0, "right")
    null = np.r_[0.0, np.cumsum(w * y * y)]
    at = np.flatnonzero(own & (stop - start >= cfg.points) & (null[stop] - null[start] >= cfg.gain))
    if not len(at):
        return []
    t0, back = np.unique(t[at], return_inverse=True)  # equal times have equal windows
    tol = 1e-13 if lf is None else 1e-11
    powers = Powers(lf, *cfg.colour_range, tol=tol), Powers(lf, *cfg.colour_range, factor=2.0, tol=tol)
    sums = shape_sums(t, (powers[0].at_nodes() * (w * y), powers[1].at_nodes() * w), t0, length, tol)
    amp, alpha, delta = np.full((3, len(SHAPES), len(t0)), np.nan)
    for i, (p, q) in enumerate(sums):
        for k in (slice(j, j + 4096) for j in range(0, len(t0), 4096)):
            num, den = powers[0].function(p[:, k]), powers[1].function(q[:, k])

            def gain(a: np.ndarray) -> np.ndarray:
                u, v = num(a), den(a)
                return np.where(v > 0, u * u / np.where(v > 0, v, 1.0), -np.inf)

            n = p[:, k].shape[1]
            a = np.zeros(n)
            if lf is not None:
                a = alpha[i, k] = golden_max_all(gain, n, *cfg.colour_range, cfg.colour_tol, cfg.colour_rounds)[0]
            delta[i, k] = gain(a)
            with np.errstate(divide="ignore", invalid="ignore"):
                amp[i, k] = num(a) / den(a)
    delta = np.where(np.isfinite(amp), delta, -np.inf)
    best = np.argmax(alike(delta), axis=0)  # the first of equal ones
    pick = lambda v: v[best, np.arange(len(t0))]
    amp, alpha, delta = pick(amp), pick(alpha), pick(delta)
    return [(int(i), SHAPES[best[j]], float(amp[j]), float(alpha[j]), float(delta[j])) for i, j in zip(at, back) if delta[j] >= cfg.gain]


def alike(score: np.ndarray) -> np.ndarray:
    """Scores to ten digits: what is equal but for the order of summing is equal."""
    mantissa, power = np.frexp(score)
    return np.ldexp(np.round(mantissa * 2.0**34) / 2.0**34, power)


def bump_events(df: DataFrame, keys: list[str], cfg: Options = options("bump", on=True), *, use: Column | None = None, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", time: str = "mjd", row_id: str = "toa_id") -> DataFrame:
    """(keys, row_id, t0, duration, model, amp, alpha, delta_chi2, rank) of the kept bumps.

    Every duration is scanned in time buckets of the longest one with the rows
    of both neighbours at hand.  Of bumps that share a row the stronger is kept.
    """
    ok = F.col(time).isNotNull() & F.col(resid).isNotNull() & (F.col(sigma) > 0)
    if cfg.colour:
        ok = ok & F.col(freq).isNotNull() & (F.col(freq) > 0)
    ok = ok if use is None else ok & use
    lengths = [float(x) for x in np.linspace(cfg.lengths[0], cfg.lengths[1], cfg.n_lengths)]
    base = df.where(ok).select(*keys, F.col(row_id).alias("_id"), F.col(time).alias("_t"), F.col(resid).alias("_y"), (F.lit(1.0) / (F.col(sigma) * F.col(sigma))).alias("_w"), (F.col(freq) if cfg.colour else F.lit(1.0)).alias("_f"))
    place = [F.struct((F.floor(F.col("_t") / F.lit(max(lengths))) + k).alias("b"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)]
    rows = base.withColumn("_p", F.explode(F.array(*place))).select(*base.columns, F.col("_p.b").alias("_b"), F.col("_p.own").alias("_own"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    id_type = df.schema[row_id].dataType.simpleString()
    cand = f"{fields}, `{row_id}` {id_type}, t0 double, duration double, model string, amp double, alpha double, delta_chi2 double"
    names = [row_id, "t0", "duration", "model", "amp", "alpha", "delta_chi2"]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], kind="stable").reset_index(drop=True)
        t, y, w, f = (pdf[c].to_numpy(float) for c in ("_t", "_y", "_w", "_f"))
        mid, own = float(np.median(f)), pdf["_own"].to_numpy(bool)
        lf = np.log(f / mid) if cfg.colour else None
        out, mine = [], t[own]
        for length in lengths if len(mine) else []:
            k = slice(*np.searchsorted(t, [mine[0] - length, mine[-1] + length]))
            got = chunk_bumps(t[k], y[k], w[k], None if lf is None else lf[k], own[k], length, cfg)
            at = np.array([g[0] for g in got], int) + k.start
            alpha = np.array([g[3] for g in got], float)
            one = pd.DataFrame({row_id: pdf["_id"].to_numpy()[at], "t0": t[at], "duration": length, "model": np.array([g[1] for g in got], object), "amp": np.array([g[2] for g in got], float) * (mid ** np.nan_to_num(alpha)), "alpha": alpha, "delta_chi2": np.array([g[4] for g in got], float)})
            one["_a"], one["_z"] = t[np.searchsorted(t, t[at] - length / 2, "left")], t[np.searchsorted(t, t[at] + length / 2, "right") - 1]
            out.append(one)
        out = pd.concat(out) if out else pd.DataFrame(columns=[*names, "_a", "_z"])
        for k in keys:
            out[k] = np.full(len(out), pdf[k].iloc[0])
        return out[[*keys, *names, "_a", "_z"]]

    found = rows.groupBy(*keys, "_b").applyInPandas(scan, f"{cand}, _a double, _z double")

    def choose(cands: pd.DataFrame) -> pd.DataFrame:
        cands = cands.assign(_o=alike(cands["delta_chi2"].to_numpy(float))).sort_values(["_o", "t0", row_id, "duration"], ascending=[False, True, True, True], kind="stable")
        kept, begins, ends = [], [], []  # kept windows share no row, so they are in order
        for i, (a, z) in enumerate(zip(cands["_a"].tolist(), cands["_z"].tolist())):
            if cfg.exclusive:
                k = bisect.bisect_left(ends, a)
                if k < len(begins) and begins[k] <= z:
                    continue
                begins.insert(k, a)
                ends.insert(k, z)
            kept.append(i)
        return cands.iloc[kept].drop(columns=["_a", "_z", "_o"]).assign(rank=np.arange(len(kept), dtype=np.int32))

    # accepted candidates only: two windows share a row if their first and last rows overlap
    return found.groupBy(*keys).applyInPandas(choose, f"{cand}, rank int")


def detect_bumps(df: DataFrame, keys: list[str], cfg: Options = options("bump", on=True), *, exclude: Column | None = None, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", time: str = "mjd", row_id: str = "toa_id") -> DataFrame:
    """Adds gaussian_bump_id, _amp, _t0, _duration_days, _alpha, _delta_chi2, _model and gaussian_bump_member."""
    use = ~F.coalesce(exclude, F.lit(False)) if exclude is not None else None
    ev = bump_events(df, keys, cfg, use=use, resid=resid, sigma=sigma, freq=freq, time=time, row_id=row_id)
    ev = small(ev.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in ("rank", "amp", "t0", "duration", "alpha", "delta_chi2", "model")]))
    rows = df.where((F.col(sigma) > 0) & F.col(time).isNotNull()) if use is None else df.where(use & (F.col(sigma) > 0) & F.col(time).isNotNull())
    d, length = F.abs(F.col(time) - F.col("_e_t0")), F.col("_e_duration")
    curve = (
        F.when(F.col("_e_model") == "gaussian", F.exp(-0.5 * F.pow(d / (length / 6), F.lit(2))))
        .when(F.col("_e_model") == "laplace", F.exp(-d / (length / 6)))
        .otherwise(F.exp(-F.greatest(F.lit(0.0), d - length / 6) / (length / 10)))
    )
    if cfg.colour:
        curve = curve * F.pow(F.when(F.col(freq) > 0, F.col(freq)), -F.col("_e_alpha"))
    at = rows.join(ev, keys).where((d <= length / 2) & (F.abs(F.col("_e_amp")) * curve / F.col(sigma) >= cfg.eta))
    p, cols = "gaussian_bump", {"id": "rank", "amp": "amp", "t0": "t0", "duration_days": "duration", "alpha": "alpha", "delta_chi2": "delta_chi2", "model": "model"}
    best = at.groupBy(row_id).agg(F.max(F.struct(*[F.col(f"_e_{c}").alias(n) for n, c in cols.items()])).alias("_m"))
    best = best.select(row_id, *[F.col(f"_m.{n}").alias(f"{p}_{n}") for n in cols], F.lit(True).alias(f"{p}_member"))
    best = best.withColumn(f"{p}_alpha", F.nanvl(f"{p}_alpha", F.lit(None)))
    return df.join(best, row_id, "left").fillna(-1, subset=[f"{p}_id"]).fillna(False, subset=[f"{p}_member"])
