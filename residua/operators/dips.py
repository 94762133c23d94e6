"""Exponential dips, achromatic or scaling with a fitted power of frequency."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.functions.windows import Powers, blocks, golden_max_all, straddling
from residua.operators.transients import BUCKET_WINDOWS, event_rows, keep_best, scan_starts

#: windows that a bucket of the search spans, and starts that are searched at once
CHUNK_WINDOWS, AT_ONCE = 4, 2048


def chunk_dips(t: np.ndarray, y: np.ndarray, w: np.ndarray, freq: np.ndarray, own: np.ndarray, cfg: Options) -> list[tuple[int, float, float, float]]:
    """(row, amplitude, alpha, delta_chi2) of the own rows that start an accepted dip; rows sorted by time.

    The powers of all starts are searched at once, on window sums.
    """
    tau, width = cfg.decay_days, cfg.reach * cfg.decay_days
    start = np.searchsorted(t, t, "left")
    stop = np.searchsorted(t, t + width, "right")
    null = np.r_[0.0, np.cumsum(w * y * y)]
    worth = own & (stop - start >= cfg.points) & (null[stop] - null[start] >= cfg.gain) & (t[stop - 1] - t >= cfg.least_days)
    at = np.flatnonzero(worth)
    if not len(at):
        return []
    t0, back = np.unique(t[at], return_inverse=True)  # equal times have equal windows
    first, end = np.searchsorted(t, t0, "left"), np.searchsorted(t, t0 + width, "right")
    lf = np.log(freq / np.median(freq)) if cfg.colour else None
    scale = float(np.median(freq)) if cfg.colour else 1.0
    powers = Powers(lf, *cfg.colour_range), Powers(lf, *cfg.colour_range, factor=2.0)
    sums = [np.empty((p.size(), len(t0))) for p in powers]
    for k in blocks(t0, width, [(first, end)]):
        lo, hi, near = first[k], end[k], slice(first[k][0], end[k][-1])
        fade = np.exp(-(t[near] - t0[k][-1]) / tau)
        rise = np.exp((t0[k] - t0[k][-1]) / tau)
        sums[0][:, k] = straddling(powers[0].at_nodes(near) * (w[near] * y[near] * fade), near.start, lo, hi) * rise
        sums[1][:, k] = straddling(powers[1].at_nodes(near) * (w[near] * fade * fade), near.start, lo, hi) * (rise * rise)
    amp, alpha, delta = np.full((3, len(t0)), np.nan)
    for k in (slice(j, j + AT_ONCE) for j in range(0, len(t0), AT_ONCE)):
        num, den = powers[0].function(sums[0][:, k]), powers[1].function(sums[1][:, k])

        def gain(a: np.ndarray) -> np.ndarray:
            p, q = num(a), den(a)
            good = (q > 0) & (p < 0)
            return np.where(good, p * p / np.where(good, q, 1.0), -np.inf)

        n = len(t0[k])
        if lf is None:
            a = np.zeros(n)
            delta[k] = gain(a)
        else:
            a, delta[k] = golden_max_all(gain, n, *cfg.colour_range, cfg.colour_tol, cfg.colour_rounds)
            alpha[k] = a
        with np.errstate(divide="ignore", invalid="ignore"):
            amp[k] = num(a) / den(a) * scale**a
    kept = (delta[back] >= cfg.gain) & np.isfinite(amp[back])
    return [(int(i), float(amp[j]), float(alpha[j]), float(delta[j])) for i, j in zip(at[kept], back[kept])]


def dip_events(df: DataFrame, keys: list[str], cfg: Options = options("dip"), *, use: Column | None = None, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", time: str = "mjd", row_id: str = "toa_id") -> DataFrame:
    """(keys, row_id, t0, amp, alpha, delta_chi2, rank) of the kept dips.

    Without a frequency dependence all starts are scanned with running sums.
    Else rows go to their time bucket of a few windows' length and, those that
    follow within a window, to the one before, and each bucket is searched by
    itself.
    """
    width = cfg.reach * cfg.decay_days
    if not cfg.colour:  # the template splits into a factor of the row and one of the start
        deep = lambda amp, t0, last: (amp < 0) & (last - t0 >= cfg.least_days)
        found = scan_starts(df, keys, tau=cfg.decay_days, width=width, min_points=cfg.points, threshold=cfg.gain, use=use, resid=resid, sigma=sigma, time=time, row_id=row_id, accept=deep, settle_them=cfg.exclusive)
        found = found.select(*keys, row_id, "t0", "amp", F.lit(None).cast("double").alias("alpha"), "delta_chi2", *["_kept"] * cfg.exclusive)
        return keep_best(found, keys, width, row_id=row_id, suppress=cfg.exclusive, settled_in=width * BUCKET_WINDOWS)
    ok = F.col(time).isNotNull() & F.col(resid).isNotNull() & (F.col(sigma) > 0)
    if cfg.colour:
        ok = ok & F.col(freq).isNotNull() & (F.col(freq) > 0)
    ok = ok if use is None else ok & use
    span = width * CHUNK_WINDOWS
    b = F.floor(F.col(time) / F.lit(span))
    follows = F.when(F.col(time) - b * F.lit(span) <= F.lit(width), F.struct((b - 1).alias("b"), F.lit(False).alias("own")))
    rows = df.where(ok).select(
        *keys, F.col(row_id).alias("_id"), F.col(time).alias("_t"), F.col(resid).alias("_y"), (F.lit(1.0) / (F.col(sigma) * F.col(sigma))).alias("_w"),
        (F.col(freq) if cfg.colour else F.lit(1.0)).alias("_f"),
        F.explode(F.array_compact(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), follows))).alias("_p"),
    ).select("*", F.col("_p.b").alias("_b"), F.col("_p.own").alias("_own")).drop("_p")
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], kind="stable").reset_index(drop=True)
        got = chunk_dips(*(pdf[c].to_numpy(float) for c in ("_t", "_y", "_w", "_f")), pdf["_own"].to_numpy(bool), cfg)
        at = [g[0] for g in got]
        out = pdf.iloc[at][[*keys, "_id", "_t"]].copy()
        for k, name in enumerate(("amp", "alpha", "delta_chi2"), 1):
            out[name] = [g[k] for g in got]
        return out

    found = rows.groupBy(*keys, "_b").applyInPandas(one, f"{fields}, _id {df.schema[row_id].dataType.simpleString()}, _t double, amp double, alpha double, delta_chi2 double")
    found = found.withColumnRenamed("_id", row_id).withColumnRenamed("_t", "t0").withColumn("alpha", F.nanvl("alpha", F.lit(None)))
    return keep_best(found, keys, width, row_id=row_id, suppress=cfg.exclusive)


def dip_members(df: DataFrame, keys: list[str], cfg: Options = options("dip"), *, use: Column | None = None, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", time: str = "mjd", row_id: str = "toa_id", prefix: str = "exp_dip_global", events: DataFrame | None = None) -> DataFrame:
    """(row_id, <prefix>_id, _amp, _t0, _delta_chi2, _alpha, exp_dip_member) of the members; an event's own seed is always one."""
    ev = events if events is not None else dip_events(df, keys, cfg, use=use, resid=resid, sigma=sigma, freq=freq, time=time, row_id=row_id)
    ev = ev.select(*keys, F.col("rank").cast("int").alias("_k"), F.col(row_id).alias("_seed"), "t0", F.col("amp").alias("_a"), F.col("alpha").alias("_al"), F.col("delta_chi2").alias("_d"))
    width = cfg.reach * cfg.decay_days
    at = event_rows(df if use is None else df.where(use), ev, keys, width, time=time)
    size = F.abs("_a") * F.exp(-(F.col(time) - F.col("t0")) / F.lit(cfg.decay_days))
    if cfg.colour:
        size = size * F.pow(F.when(F.col(freq) > 0, F.col(freq)), -F.col("_al"))
    at = at.where(((F.col(sigma) > 0) & (size / F.col(sigma) >= cfg.eta)) | (F.col(row_id) == F.col("_seed")))
    cols = {"id": "_k", "amp": "_a", "t0": "t0", "delta_chi2": "_d", "alpha": "_al"}
    best = at.groupBy(row_id).agg(F.max(F.struct(*[F.col(c).alias(n) for n, c in cols.items()])).alias("_m"))
    return best.select(row_id, *[F.col(f"_m.{n}").alias(f"{prefix}_{n}") for n in cols], F.lit(True).alias("exp_dip_member"))


def with_dips(df: DataFrame, members: DataFrame, *, row_id: str = "toa_id", prefix: str = "exp_dip_global") -> DataFrame:
    """``df`` with the columns of ``dip_members``."""
    return df.join(members, row_id, "left").fillna(-1, subset=[f"{prefix}_id"]).fillna(False, subset=["exp_dip_member"])


def detect_dips(df: DataFrame, keys: list[str], cfg: Options = options("dip"), *, row_id: str = "toa_id", prefix: str = "exp_dip_global", **how) -> DataFrame:
    """Adds the columns of ``dip_members``; other arguments are those of it."""
    return with_dips(df, dip_members(df, keys, cfg, row_id=row_id, prefix=prefix, **how), row_id=row_id, prefix=prefix)
