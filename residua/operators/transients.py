"""Exponential transients: scan of all start times, suppression, members.

The template exp(-(t - t0)/tau) splits into a factor of the row and one of the
start, so every window sum comes from two running sums: to the end of the time
bucket of the window's length in which it starts, and from there on.  Cost is
that of sorting, however many rows a window holds, and a long series spreads
over chunks of buckets; rows of a chunk's first bucket go to the one before, too.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.options import Options, options
from residua.operators.blocks import exact_median, small


#: windows that a chunk of the scan and a bucket of the choice among candidates span
BUCKET_WINDOWS = 16


def chunk_starts(t: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray, tau: float, width: float) -> tuple[np.ndarray, ...]:
    """(row, amp, delta_chi2, n, last) of the windows that start at own rows; rows sorted by time.

    A window's rows are the end of its time bucket and the beginning of the
    next, so its sums are one of either and no difference of larger ones.
    """
    bucket = np.floor(t / width)
    starts = np.unique(bucket[own])
    if not len(starts):
        return np.empty(0, np.int64), *[np.empty(0)] * 2, np.empty(0, np.int64), np.empty(0)
    i, m, z = (np.searchsorted(bucket, starts + k) for k in range(3))
    # buckets that hold about as many rows are lines of one array, each filled up with zeros
    long, parts = np.log2(z - i).astype(int), []
    for k in np.unique(long):
        parts.append(_of_buckets(t, y, w, own, tau, width, starts[long == k], i[long == k], m[long == k], z[long == k]))
    at, *values = map(np.concatenate, zip(*parts))
    order = np.argsort(at, kind="stable")
    return at[order], *[v[order] for v in values]


def _of_buckets(t: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray, tau: float, width: float, b: np.ndarray, i: np.ndarray, m: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """``chunk_starts`` for the time buckets ``b``: rows i to m of a bucket, m to z of the next."""

    def sums(first: np.ndarray, end: np.ndarray, back: bool) -> np.ndarray:
        """(2, buckets, rows + 1): sums from the edge on, up to and without each row; or back from it, with the row k before it at k."""
        far = np.arange(max(1, int((end - first).max())))
        row = end[:, None] - 1 - far if back else first[:, None] + far
        there = far < (end - first)[:, None]
        row = np.where(there, row, 0)
        fade = np.exp(-np.where(there, (t[row] - (b[:, None] + 1) * width) / tau, 0.0))
        terms = np.where(there, np.stack((w[row] * y[row] * fade, w[row] * fade * fade)), 0.0)
        out = np.zeros((2, len(b), len(far) + 1))
        np.cumsum(terms, axis=2, out=out[:, :, 1:])
        return out

    before, after = sums(i, m, True), sums(m, z, False)
    line = np.repeat(np.arange(len(b)), m - i)
    at = i[line] + np.arange(len(line)) - np.repeat(np.cumsum(m - i) - (m - i), m - i)
    line, at = line[own[at]], at[own[at]]
    t0 = t[at]
    # windows never reach beyond the next bucket, but for rounding
    first, end = np.searchsorted(t, t0, "left"), np.clip(np.searchsorted(t, t0 + width, "right"), m[line], z[line])
    num, den = before[:, line, m[line] - first] + after[:, line, end - m[line]]
    good = den > 0
    den, rise = np.where(good, den, 1.0), np.exp((t0 - (b[line] + 1) * width) / tau)
    return at, np.where(good, num / den / rise, np.nan), np.where(good, num * num / den, -np.inf), end - first, t[end - 1]


def scan_starts(df: DataFrame, keys: list[str], *, tau: float, width: float, min_points: int, threshold: float, use: Column | None = None, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id", accept: Callable[..., np.ndarray] | None = None, settle_them: bool = False) -> DataFrame:
    """(keys, row_id, t0, amp, delta_chi2, n, last) of each used row whose window [t0, t0 + width] reaches the threshold.

    amp = sum(w f y)/sum(w f^2), delta_chi2 = (sum w f y)^2 / sum(w f^2); last is
    the time of the window's last row.
    Rows with a null time or value, or without a positive sigma, are not used.
    ``accept`` chooses among the windows by amp, t0 and last.  With
    ``settle_them`` they are settled in buckets of ``BUCKET_WINDOWS`` windows
    (see ``keep_best``) and have the column _kept.
    """
    s = F.col(sigma)
    ok = F.col(time).isNotNull() & F.col(resid).isNotNull() & (s > 0)
    ok = ok if use is None else ok & use
    span = width * BUCKET_WINDOWS
    b = F.floor(F.col(time) / F.lit(span))
    follows = F.when(F.floor(F.col(time) / F.lit(width)) == b * BUCKET_WINDOWS, F.struct((b - 1).alias("b"), F.lit(False).alias("own")))
    placed = F.explode(F.array_compact(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), follows)))
    rows = df.where(ok).select(*keys, F.col(row_id), F.col(time).alias("t0"), F.col(resid).cast("double").alias("_y"), (F.lit(1.0) / (s * s)).alias("_w"), placed.alias("_p"))
    rows = rows.select(*keys, row_id, "t0", "_y", "_w", F.col("_p.b").alias("_b"), F.col("_p.own").alias("_own"))
    of_rows = rows.select(*keys, row_id, "t0").schema.fields
    made = [("amp", T.DoubleType()), ("delta_chi2", T.DoubleType()), ("n", T.LongType()), ("last", T.DoubleType())] + [("_kept", T.BooleanType())] * settle_them

    def scan(key, table):
        table = table.take(pc.sort_indices(table, [("t0", "ascending"), (row_id, "ascending")]))
        t, y, w, own = (table.column(c).to_numpy().astype(kind) for c, kind in (("t0", float), ("_y", float), ("_w", float), ("_own", bool)))
        at, amp, delta, n, last = chunk_starts(t, y, w, own, tau, width)
        good = (n >= min_points) & (delta >= threshold)
        if accept is not None:
            good &= accept(amp, t[at], last)
        found = table.take(pa.array(at[good], pa.int64())).select([*keys, row_id, "t0"])
        for (name, _), v in zip(made, (amp, delta, n.astype(np.int64), last)):
            found = found.append_column(name, pa.array(v[good]))
        if settle_them:
            low = key[-1].as_py() * span
            found = settled(found.append_column("_kept", pa.array(np.zeros(found.num_rows, bool))), width, row_id, low, low + span)
        return found

    return rows.groupBy(*keys, "_b").applyInArrow(scan, T.StructType([*of_rows, *[T.StructField(n, k) for n, k in made]]))


def settle(t: list[float], score: list[float], ident: list, kept: list[bool], width: float, low: float | None = None, high: float | None = None) -> list[bool | None]:
    """Greedy choice by falling score (then time, id) among candidates that are no further apart than ``width``.

    Gives for each candidate True (kept), False (dropped) or None (not known
    yet): candidates outside [low, high) may be there that are not seen.
    ``kept`` marks those that are kept already.
    """
    state: list[bool | None] = [True if k else None for k in kept]
    sure = sorted(x for x, k in zip(t, kept) if k)
    open_: list[float] = []

    def near(times: list[float], x: float) -> bool:
        k = bisect.bisect_left(times, x - width)
        return k < len(times) and times[k] <= x + width

    for _, x, _, i in sorted(zip([-v for v in score], t, ident, range(len(t)))):
        if kept[i]:
            continue
        if near(sure, x):
            state[i] = False
        elif near(open_, x) or (low is not None and (x - width < low or x + width >= high)):
            bisect.insort(open_, x)
        else:
            state[i] = True
            bisect.insort(sure, x)
    return state


def keep_best(cands: DataFrame, keys: list[str], width: float, *, row_id: str = "toa_id", suppress: bool = True, settled_in: float | None = None) -> DataFrame:
    """Greedy choice by falling delta_chi2 (then t0, row id) of candidates whose windows share no start; adds ``rank`` from 0.

    Candidates are settled in time buckets, where all but those that depend on
    what lies beyond a bucket's ends are decided; these are looked at again in
    buckets shifted by half, and what then is left, with the kept ones, per
    series.  The result is that of one pass over the whole series, but no task
    sees all its candidates.  With ``settled_in`` they have been settled in
    buckets of that length, and have the column _kept.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("delta_chi2"), "t0", row_id)) - 1
    if not suppress:
        return cands.drop("_kept").withColumn("rank", rank)
    span = settled_in or width * BUCKET_WINDOWS
    out = cands if settled_in else cands.withColumn("_kept", F.lit(False))
    schema = out.schema
    ranked = T.StructType([*[f for f in schema.fields if f.name != "_kept"], T.StructField("rank", T.IntegerType())])

    def in_bucket(shift: float):
        def one(key, table):
            low = key[-1].as_py() * span + shift
            return settled(table.drop_columns(["_b"]), width, row_id, low, low + span)

        return one

    def in_series(key, table):
        done = settled(table, width, row_id)
        score, t0, ident = (done.column(c).to_pylist() for c in ("delta_chi2", "t0", row_id))
        order = sorted(range(done.num_rows), key=lambda i: (-score[i], t0[i], ident[i]))
        done = done.take(pa.array(order, pa.int64())).drop_columns(["_kept"])
        return done.append_column("rank", pa.array(range(done.num_rows), pa.int32()))

    for shift in (span / 2,) if settled_in else (0.0, span / 2):
        out = out.withColumn("_b", F.floor((F.col("t0") - F.lit(shift)) / F.lit(span))).groupBy(*keys, "_b").applyInArrow(in_bucket(shift), schema)
    return out.groupBy(*keys).applyInArrow(in_series, ranked)


def settled(table: pa.Table, width: float, row_id: str, low: float | None = None, high: float | None = None) -> pa.Table:
    """The candidates that ``settle`` does not drop, marked in _kept if they are kept for certain."""
    state = settle(*(table.column(c).to_numpy().tolist() for c in ("t0", "delta_chi2", row_id, "_kept")), width, low, high)
    at = pa.array([i for i, s in enumerate(state) if s is not False], pa.int64())
    return table.take(at).set_column(table.column_names.index("_kept"), "_kept", pa.array([bool(s) for s in state if s is not False], pa.bool_()))


def event_rows(df: DataFrame, events: DataFrame, keys: list[str], width: float, *, time: str = "mjd") -> DataFrame:
    """Rows joined to the events whose window [t0, t0 + width] holds them, through time buckets."""
    b = F.floor(F.col("t0") / F.lit(width))
    ev = events.withColumn("_b", F.explode(F.array(b, b + 1)))
    rows = df.where(F.col(time).isNotNull()).withColumn("_b", F.floor(F.col(time) / F.lit(width)))
    return rows.join(small(ev), [*keys, "_b"]).where(F.col(time).between(F.col("t0"), F.col("t0") + F.lit(width))).drop("_b")


def transient_events(df: DataFrame, keys: list[str], cfg: Options, *, use: Column | None = None, resid: str = "resid", sigma: str = "sigma") -> DataFrame:
    width = cfg.reach * cfg.decay_days
    found = scan_starts(df, keys, tau=cfg.decay_days, width=width, min_points=cfg.points, threshold=cfg.gain, use=use, resid=resid, sigma=sigma, settle_them=cfg.exclusive)
    return keep_best(found, keys, width, suppress=cfg.exclusive, settled_in=width * BUCKET_WINDOWS)


def detect_transients(df: DataFrame, keys: list[str], cfg: Options = options("transient"), *, use: Column | None = None, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id", prefix: str = "transient", events: DataFrame | None = None, into: DataFrame | None = None) -> DataFrame:
    """Adds <prefix>_id (rank of the event, -1 for none), _amp, _t0, _delta_chi2 of members, |A f|/sigma >= eta; to ``into``, the same rows with further columns, where it is given."""
    ev = events if events is not None else transient_events(df, keys, cfg, use=use, resid=resid, sigma=sigma)
    ev = ev.select(*keys, F.col("rank").cast("int").alias(f"{prefix}_id"), F.col("amp").alias(f"{prefix}_amp"), "t0", F.col("delta_chi2").alias(f"{prefix}_delta_chi2"))
    width = cfg.reach * cfg.decay_days
    at = event_rows(df if use is None else df.where(use), ev, keys, width, time=time)
    z = F.abs(f"{prefix}_amp") * F.exp(-(F.col(time) - F.col("t0")) / F.lit(cfg.decay_days)) / F.col(sigma)
    cols = [f"{prefix}_id", f"{prefix}_amp", f"{prefix}_t0", f"{prefix}_delta_chi2"]
    members = at.where((F.col(sigma) > 0) & (z >= cfg.eta)).withColumnRenamed("t0", f"{prefix}_t0")
    # without suppression a row may be in several events: the last written, of highest rank, holds
    best = members.groupBy(row_id).agg(F.max(F.struct(*cols)).alias("_m")).select(row_id, *[F.col(f"_m.{c}").alias(c) for c in cols])
    return (df if into is None else into).join(best, row_id, "left").fillna(-1, subset=[f"{prefix}_id"])


def detect_global_transients(df: DataFrame, series: list[str], group: str, cfg: Options = options("transient"), *, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id", prefix: str = "transient_global") -> DataFrame:
    """Events of the whole series, amplitude and members (|A f|/sigma > eta) refitted in every group, with their z."""
    ev = transient_events(df, series, cfg, resid=resid, sigma=sigma).select(*series, F.col("rank").cast("int").alias("rank"), "t0", "delta_chi2")
    width, tau = cfg.reach * cfg.decay_days, cfg.decay_days
    at = event_rows(df, ev, series, width, time=time).where(F.col(sigma) > 0)
    f = F.exp(-(F.col(time) - F.col("t0")) / F.lit(tau))
    at = at.withColumns({"_f": f, "_w": F.lit(1.0) / (F.col(sigma) * F.col(sigma))})
    fit = at.where(F.col(resid).isNotNull()).groupBy(*series, group, "rank").agg(
        F.count("*").alias("_n"), (F.sum(F.col("_w") * F.col("_f") * F.col(resid)) / F.sum(F.col("_w") * F.col("_f") * F.col("_f"))).alias("_amp")
    )
    at = at.join(small(fit.where(F.col("_n") >= 2).drop("_n")), [*series, group, "rank"])
    at = at.withColumn("_z", F.abs(F.col("_amp") * F.col("_f")) / F.col(sigma)).where(F.col("_z") > cfg.eta)
    stats = at.groupBy(*series, group, "rank").agg(
        F.count("*").alias(f"{prefix}_n_members"), F.avg((F.col("_z") < 1).cast("double")).alias(f"{prefix}_frac_z_lt1"),
        F.min("_z").alias(f"{prefix}_z_min"), F.max("_z").alias(f"{prefix}_z_max"),
    )
    stats = stats.join(exact_median(at, [*series, group, "rank"], "_z", f"{prefix}_z_med"), [*series, group, "rank"])
    cols = {f"{prefix}_id": F.col("rank"), f"{prefix}_amp": F.col("_amp"), f"{prefix}_t0": F.col("t0"), f"{prefix}_delta_chi2": F.col("delta_chi2")}
    best = at.groupBy(*series, group, row_id).agg(F.max(F.struct(*[c.alias(n) for n, c in cols.items()])).alias("_m"))
    best = best.select(*series, group, row_id, *[F.col(f"_m.{n}").alias(n) for n in cols])
    best = best.join(small(stats.withColumnRenamed("rank", f"{prefix}_id")), [*series, group, f"{prefix}_id"]).drop(*series, group)
    out = df.join(best, row_id, "left").fillna(-1, subset=[f"{prefix}_id"])
    return out.fillna(0, subset=[f"{prefix}_n_members", f"{prefix}_frac_z_lt1"])
