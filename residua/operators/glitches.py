"""Glitches: a ramp or a recovering peak from some start to the end of the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.operators.blocks import small


def _suffix(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x[::-1])[::-1]


def _two_column_fit(aa, ab, bb, ay, by) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first coefficient, second, explained chi2) of weighted least squares from its five sums."""
    det = aa * bb - ab * ab
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (bb * ay - ab * by) / det, (aa * by - ab * ay) / det
    gain = p * ay + q * by
    bad = ~np.isfinite(gain) | (det <= 1e-12 * np.abs(aa * bb))
    return p, q, np.where(bad, -np.inf, gain)


def series_fits(t: np.ndarray, y: np.ndarray, w: np.ndarray, tau: float) -> dict[str, np.ndarray]:
    """For each start row (sorted by time) the fits of A + B dt and A exp(-dt/tau) + B dt over all rows from it on."""
    n = len(t)
    u = t - t[0]
    sw, st, stt, sy, sty = (_suffix(v) for v in (w, w * u, w * u * u, w * y, w * u * y))
    dt1, dt2, dty = st - u * sw, stt - 2 * u * st + u * u * sw, sty - u * sy
    a1, b1, d1 = _two_column_fit(sw, dt1, dt2, sy, dty)
    h, g, hh, hy = (np.zeros(n) for _ in range(4))
    for i in range(n - 1, -1, -1):
        h[i] = hh[i] = w[i]
        hy[i] = w[i] * y[i]
        if i + 1 < n:
            gap = t[i + 1] - t[i]
            e = np.exp(-gap / tau)
            h[i] += e * h[i + 1]
            g[i] = e * (g[i + 1] + gap * h[i + 1])
            hh[i] += e * e * hh[i + 1]
            hy[i] += e * hy[i + 1]
    a2, b2, d2 = _two_column_fit(hh, g, dt2, hy, dty)
    # rows of equal time all see the whole of that time
    first = np.searchsorted(t, t, "left")
    return {k: v[first] for k, v in dict(a1=a1, b1=b1, d1=d1, a2=a2, b2=b2, d2=d2).items()}


def recovery_end(t: np.ndarray, y: np.ndarray, window: float) -> np.ndarray:
    """For each row the time at which the trailing mean of the rows after it first is >= 0, else the last time."""
    n = len(t)
    c = np.r_[0.0, np.cumsum(y)]
    lo = np.searchsorted(t, t - window, "left")
    full = c[1:] - c[lo] >= 0  # trailing mean over a whole window that starts after the row
    nxt_full = np.full(n + 1, n)
    for i in range(n - 1, -1, -1):
        nxt_full[i] = i if full[i] else nxt_full[i + 1]
    # next position whose running sum is not below the row's own
    nxt = np.full(n + 1, n + 1)
    stack: list[int] = []
    for i in range(n, -1, -1):
        while stack and c[stack[-1]] < c[i]:
            stack.pop()
        nxt[i] = stack[-1] if stack else n + 1
        stack.append(i)
    after = np.searchsorted(t, t, "right")
    end = np.full(n, t[-1])
    for i in range(n):
        a = after[i]
        if a >= n:
            continue
        far = np.searchsorted(t, t[a] + window, "right")
        k = nxt[a] - 1  # row whose sum since the start is >= 0
        if k < far:
            end[i] = t[k]
        elif nxt_full[far] < n:
            end[i] = t[nxt_full[far]]
    return end


def series_glitches(t: np.ndarray, y: np.ndarray, s: np.ndarray, good: np.ndarray, cfg: Options) -> list[dict]:
    """Kept glitches of one series sorted by time; ``good`` marks rows that may be fitted."""
    at = np.flatnonzero(good)
    if len(at) < cfg.points:
        return []
    tg, yg = t[at], y[at]
    fit = series_fits(tg, yg, 1.0 / s[at] ** 2, cfg.decay_days)
    first = np.searchsorted(tg, tg, "left")
    rows_after = len(at) - first
    end = recovery_end(t, y, cfg.mean_days if cfg.mean_days > 0 else 1.0)
    best = np.maximum(fit["d1"], fit["d2"])
    kept: list[dict] = []
    for i in np.lexsort((np.arange(len(at)), -best)):
        if not best[i] >= cfg.gain:
            break
        if rows_after[i] < cfg.points or end[at[i]] - tg[i] < cfg.least_days:
            continue
        win = y[np.searchsorted(t, tg[i], "right") : np.searchsorted(t, end[at[i]], "right")]
        if not len(win):
            continue
        mid = float(np.median(win))
        if yg[i] <= mid + cfg.noise * 1.4826 * float(np.median(np.abs(win - mid))):
            continue
        peak = fit["d2"][i] > fit["d1"][i]
        kept.append({
            "rank": len(kept), "t0": float(tg[i]), "amp": float(fit["a2" if peak else "a1"][i]), "slope": float(fit["b2" if peak else "b1"][i]),
            "peak_tau_days": cfg.decay_days if peak else None, "model": "peak_ramp" if peak else "step_ramp", "delta_chi2": float(best[i]),
        })
        if cfg.exclusive:
            break  # every window runs to the end of the series, so any two share rows
    return kept


def detect_glitches(df: DataFrame, keys: list[str], cfg: Options = options("glitch", on=True), *, exclude: Column | None = None, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id") -> DataFrame:
    """Adds glitch_id, _t0, _amp, _slope, _peak_tau_days, _delta_chi2, _model and glitch_member.

    All starts of a series are fitted from suffix sums, in O(n log n) for a
    series; members are found without a UDF.  ``exclude`` marks rows that take
    no part.  A window reaches to the end of its series, so a series is one task.
    """
    out_rows = F.coalesce(exclude, F.lit(False)) if exclude is not None else F.lit(False)
    ok = F.col(time).isNotNull() & F.col(resid).isNotNull()
    rows = df.where(ok).select(*keys, F.col(row_id).alias("_id"), F.col(time).alias("_t"), F.col(resid).alias("_y"), F.col(sigma).alias("_s"), ((F.col(sigma) > 0) & ~out_rows).alias("_ok"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = ["rank", "t0", "amp", "slope", "peak_tau_days", "model", "delta_chi2"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], kind="stable")
        got = series_glitches(*(pdf[c].to_numpy(float) for c in ("_t", "_y", "_s")), pdf["_ok"].fillna(False).to_numpy(bool), cfg)
        out = pd.DataFrame(got, columns=names)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *names]]

    ev = rows.groupBy(*keys).applyInPandas(one, f"{fields}, rank int, t0 double, amp double, slope double, peak_tau_days double, model string, delta_chi2 double")
    ev = small(ev.select(*keys, F.col("rank").alias("id"), *names[1:]))
    named = ev.select(*keys, *[F.col(c).alias(f"_g_{c}") for c in ("id", *names[1:])])
    dt = F.col(time) - F.col("_g_t0")
    curve = F.when(F.col("_g_model") == "peak_ramp", F.col("_g_amp") * F.exp(-dt / F.col("_g_peak_tau_days"))).otherwise(F.col("_g_amp")) + F.col("_g_slope") * dt
    at = df.where(~out_rows & (F.col(sigma) > 0) & F.col(resid).isNotNull()).join(named, keys).where((dt >= 0) & (F.abs(curve) / F.col(sigma) >= cfg.eta))
    cols = ["id", "t0", "amp", "slope", "peak_tau_days", "delta_chi2", "model"]
    best = at.groupBy(row_id).agg(F.max(F.struct(*[F.col(f"_g_{c}").alias(c) for c in cols])).alias("_m"))
    best = best.select(row_id, *[F.col(f"_m.{c}").alias(f"glitch_{c}") for c in cols], F.lit(True).alias("glitch_member"))
    return df.join(best, row_id, "left").fillna(-1, subset=["glitch_id"]).fillna(False, subset=["glitch_member"])
