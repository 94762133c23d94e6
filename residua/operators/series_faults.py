"""Impossible, stuck and spiking values of many sources.

A local-level state-space model per source is run with a Kalman filter in both
directions of time.  Each direction predicts a row from the rows before or
after it; both predictions together, weighted by their variances, give the
innovation of the row.  A standardised innovation beyond the threshold is a
spike.  Innovations beyond a gate withhold their update, so spikes do not drag
the level; when withheld rows agree with one another the level has moved, and
that direction starts there again, which keeps steps out.  The measurement
variance of the source is estimated from its own innovations, that of a row is
never less than its own sigma squared.

A stuck source is one whose innovation variance vanishes: the model without
measurement noise (gain 1) has the change since the last row as its innovation,
and the mean square of these over ``run`` rows falls to nothing against the
variance that the source's normal behaviour predicts.

Sources are cut into time chunks of about equal counts with a halo of rows on
either side, so one source may hold any share of the table.  The usual scatter
is that of the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators.blocks import small


@dataclass(frozen=True)
class FaultConfig:
    value_limit: float = 1.0
    sigma_limit: float = 1.0
    time_min: float = 40000.0
    time_max: float = 70000.0
    #: rows of a stuck run at least, and the share of the usual scatter to which its innovations fall
    run: int = 6
    vanish: float = 1e-9
    #: standardised innovation of a spike
    threshold: float = 9.0
    #: innovations beyond this withhold their update
    gate: float = 5.0
    #: withheld rows that must agree before the level is taken as moved
    regain: int = 8
    #: growth of the level's variance a row and a day, in units of the measurement variance, and the longest gap that counts
    drift_row: float = 0.02
    drift_day: float = 0.02
    longest_gap: float = 30.0
    #: rows that make the first level
    start_rows: int = 15
    chunk_rows: int = 20000
    halo_rows: int = 64
    #: time bins per chunk that place the chunk bounds
    bins: int = 64


def impossible(value: Column, sigma: Column, time: Column, cfg: FaultConfig) -> Column:
    """Null counts as not impossible; NaN and infinities do."""
    wild = lambda c, ok: c.isNotNull() & (F.isnan(c) | ~ok)
    return F.coalesce(
        wild(value, F.abs(value) < cfg.value_limit)
        | wild(sigma, (sigma > 0) & (sigma < cfg.sigma_limit))
        | wild(time, time.between(cfg.time_min, cfg.time_max)),
        F.lit(False),
    )


def placeholder(c: Column) -> Column:
    """Null, or beginning with UNK in any case."""
    return c.isNull() | F.upper(c).startswith("UNK")


def _filter_pass(t: list, y: list, noise: list, r: float, cfg: FaultConfig) -> tuple[list[float], list[float]]:
    """Predicted level of each row, from the rows before it in the order given, and its variance.

    ``noise`` is the measurement variance of each row, ``r`` the usual one.
    Rows by which the level was found to have moved get an infinite variance:
    this direction cannot tell where they belong.
    """
    n = len(y)
    at, spread = [0.0] * n, [0.0] * n
    level, var = sorted(y[: cfg.start_rows])[min(n, cfg.start_rows) // 2], r
    limit, regain, per_row, per_day, longest = cfg.gate * cfg.gate, cfg.regain, cfg.drift_row * r, cfg.drift_day * r, cfg.longest_gap
    held: list[int] = []
    last = t[0]
    for i, v in enumerate(y):
        gap = abs(t[i] - last)
        last = t[i]
        var += per_row + per_day * (gap if gap < longest else longest)
        at[i], spread[i] = level, var
        e = v - level
        s = var + noise[i]
        if e * e <= limit * s:
            if held:
                held = []
            k = var / s
            level += k * e
            var *= 1 - k
            continue
        held.append(i)
        if len(held) >= regain:
            recent = sorted(y[j] for j in held[-regain:])
            if recent[-2] - recent[1] <= 2 * cfg.gate * r**0.5:
                level, var = recent[regain // 2], r
                for j in held[-regain:]:
                    if (y[j] - level) ** 2 <= limit * (r + noise[j]):
                        spread[j] = float("inf")
                held = []
    return at, spread


def innovations(t: np.ndarray, y: np.ndarray, sigma: np.ndarray, r: float, cfg: FaultConfig) -> tuple[np.ndarray, np.ndarray]:
    """Innovation of each row against both directions, and the variance of that prediction.

    Where the directions contradict each other (a step), the nearer one counts.
    """
    noise = np.maximum(np.nan_to_num(sigma, nan=0.0) ** 2, r)
    tl, yl, nl = t.tolist(), y.tolist(), noise.tolist()
    m1, v1 = map(np.array, _filter_pass(tl, yl, nl, r, cfg))
    m2, v2 = (np.array(x[::-1]) for x in _filter_pass(tl[::-1], yl[::-1], nl[::-1], r, cfg))
    w1, w2 = 1 / v1, 1 / v2
    lost = (w1 == 0) & (w2 == 0)
    w = np.where(lost, 1.0, w1 + w2)
    both, spread = (w1 * m1 + w2 * m2) / w, 1 / w
    with np.errstate(invalid="ignore"):
        apart = np.abs(m1 - m2) > cfg.gate * np.sqrt(v1 + v2)
    first = np.abs(y - m1) <= np.abs(y - m2)
    both = np.where(apart, np.where(first, m1, m2), both)
    spread = np.where(apart, np.where(first, v1, v2), spread)
    return np.where(lost, 0.0, y - both), np.where(lost, r, spread)


def _typical(x: np.ndarray) -> float:
    """Scatter about 0 that a normal law would have with this median of sizes."""
    return float(1.4826 * np.median(np.abs(x))) if len(x) else 0.0


def stuck_rows(y: np.ndarray, scale: float, cfg: FaultConfig) -> np.ndarray:
    """Rows of stretches whose innovation variance vanishes against ``scale`` squared."""
    out = np.zeros(len(y), bool)
    if len(y) < cfg.run:
        return out
    e = np.diff(y)
    power = np.mean(np.lib.stride_tricks.sliding_window_view(e * e, cfg.run - 1), axis=1)
    for k in np.flatnonzero(power <= (cfg.vanish * scale) ** 2):
        out[k : k + cfg.run] = True
    return out


def chunk_faults(t: np.ndarray, y: np.ndarray, sigma: np.ndarray, cfg: FaultConfig) -> tuple[np.ndarray, np.ndarray]:
    """(stuck, spike) masks of one series sorted by time."""
    n = len(y)
    change = np.diff(y)
    # the square of a tiny difference may be 0, so the differences themselves decide what is none
    scale = _typical(change[change != 0]) / 2**0.5
    stuck = stuck_rows(y, scale, cfg)
    spike = np.zeros(n, bool)
    use = np.flatnonzero(~stuck)
    if len(use) < 3:
        return stuck, spike
    tu, yu, su = t[use], y[use], sigma[use]
    r = (_typical(np.diff(yu)) / 2**0.5 or scale or 1e-300) ** 2
    e, spread = innovations(tu, yu, su, r, cfg)  # a first filter gives the usual scatter, the second decides
    r = _typical(e / np.sqrt(1 + spread / r)) ** 2 or r
    e, spread = innovations(tu, yu, su, r, cfg)
    with np.errstate(invalid="ignore"):
        z = np.abs(e) / np.sqrt(spread + np.maximum(su * su, r))
        spike[use] = z > cfg.threshold
    return stuck, spike


def _in_chunks(rows: DataFrame, keys: list[str], cfg: FaultConfig) -> DataFrame:
    """Rows with ``_chunk`` and ``_own``; rows of a halo are there once more with ``_own`` false.

    Only sources of more than ``chunk_rows`` rows are looked at again: their
    span is cut into equal bins, bins that hold much are cut once more, and the
    bins are dealt out to chunks by their counts.  The table of bins has one row
    per few hundred rows of the large sources and is sent to the executors only
    if it is small as stored.
    """
    whole = F.lit(0).cast("bigint").alias("_chunk"), F.lit(True).alias("_own")
    large = small(
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_all"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        .where(F.col("_all") > cfg.chunk_rows)
        .select(*keys, "_all", "_lo", "_hi", F.ceil(F.col("_all") / cfg.chunk_rows).alias("_parts"))
    )
    if large.isEmpty():
        return rows.select(*keys, "_id", "_t", "_y", "_e", *whole)
    place = (F.col("_t") - F.col("_lo")) * F.col("_parts") * cfg.bins / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    of_large = rows.select(*keys, "_t").join(large, keys).withColumn("_p", place).withColumn("_bin", F.floor("_p"))
    full = of_large.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).select(*keys, "_bin", F.ceil(F.col("_n") * 16 / cfg.chunk_rows).alias("_cuts"))
    full = small(full)
    sub = F.floor((F.col("_p") - F.col("_bin")) * F.col("_cuts"))
    hist = of_large.join(full, [*keys, "_bin"]).groupBy(*keys, "_bin", sub.alias("_sub"), "_all", "_parts").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin", "_sub")
    hist = hist.withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("_n"))
    # numbers without gaps, as a bin may hold more than one chunk's share
    hist = hist.withColumn("_chunk", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.floor(F.col("_start") * F.col("_parts") / F.col("_all")))).cast("bigint"))
    wc = Window.partitionBy(*keys, "_chunk")
    hist = hist.withColumns({"_c0": F.min("_start").over(wc), "_c1": F.max("_end").over(wc)})
    after = (F.col("_end") > F.col("_c1") - cfg.halo_rows) & (F.col("_c1") < F.col("_all"))
    before = (F.col("_start") < F.col("_c0") + cfg.halo_rows) & (F.col("_c0") > 0)
    bounds = small(hist.select(*keys, "_bin", "_sub", "_chunk", after.alias("_after"), before.alias("_before")))
    placed = (
        rows.join(large, keys, "left")
        .withColumn("_p", place).withColumn("_bin", F.floor("_p"))
        .join(full, [*keys, "_bin"], "left").withColumn("_sub", sub)
        .join(bounds, [*keys, "_bin", "_sub"], "left")
    )
    to = lambda c, own: F.struct(c.alias("c"), F.lit(own).alias("own"))
    copies = F.array_compact(
        F.array(
            to(F.coalesce("_chunk", F.lit(0).cast("bigint")), True),
            F.when(F.col("_after"), to(F.col("_chunk") + 1, False)),
            F.when(F.col("_before"), to(F.col("_chunk") - 1, False)),
        )
    )
    placed = placed.withColumn("_to", F.explode(copies))
    return placed.select(*keys, "_id", "_t", "_y", "_e", F.col("_to.c").alias("_chunk"), F.col("_to.own").alias("_own"))


def find_faults(
    df: DataFrame,
    *,
    row_id: str = "toa_id",
    source: tuple[str, ...] = ("psr", "grp"),
    group: str = "grp",
    time: str = "mjd",
    value: str = "resid",
    sigma: str = "sigma",
    cfg: FaultConfig = FaultConfig(),
) -> DataFrame:
    """Rows (row_id, kind) with kind impossible, stuck or spike; at most one per row.

    Defined cases: nulls are not impossible; rows with a null time, value or
    source part, or a placeholder group, are never stuck or spikes; a null
    sigma is never a spike; equal times are ordered by row id; repeated rows
    are rows; a source of fewer than three usable rows has no spikes; rows of
    one source at one very instant are never cut apart, so that many of them
    share a task; an empty table gives an empty result; other columns are
    ignored.
    """
    src = df.select(
        F.col(row_id).alias("_id"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(source)], F.col(group).alias("_g"),
        F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_y"), F.col(sigma).cast("double").alias("_e"),
    )
    wild = impossible(F.col("_y"), F.col("_e"), F.col("_t"), cfg)
    keys = [f"_s{i}" for i in range(len(source))]
    usable = ~wild & F.col("_t").isNotNull() & F.col("_y").isNotNull() & ~placeholder(F.col("_g"))
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    rows = _in_chunks(src.where(usable).drop("_g"), keys, cfg)

    id_type = df.schema[row_id].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], kind="stable")
        stuck, spike = chunk_faults(pdf["_t"].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_e"].to_numpy(float), cfg)
        mine = pdf["_own"].to_numpy(bool)
        at = np.flatnonzero((stuck | spike) & mine)
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[at], "kind": np.where(stuck[at], "stuck", "spike").astype(object)})

    rest = rows.groupBy(*keys, "_chunk").applyInPandas(one, f"_id {id_type}, kind string")
    first = src.where(wild).select("_id", F.lit("impossible").alias("kind"))
    return first.unionByName(rest).withColumnRenamed("_id", row_id)
