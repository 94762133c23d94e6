"""Events tied to a covariate: amplitude * exp(-x / scale) / freq^alpha.

x is the solar elongation (solar events) or the folded distance from a phase
(eclipses).  Scale and alpha are searched on a grid that narrows around its
best point.  A group is fitted in one task while it fits there, and by passes
of map-side sums beyond that; both evaluate the same points and agree but for
the order of sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.functions.stats import folded_distance, year_of_mjd
from residua.operators.blocks import small
from residua.operators.outliers import with_group_value

ROWS_IN_TASK = 1_000_000


GRID, PASSES = 7, 12


def _narrow(lo: float, hi: float, at: float, grid: int) -> tuple[float, float]:
    step = (hi - lo) / (grid - 1)
    return max(lo, at - step), min(hi, at + step)


def _points(lo: float, hi: float, grid: int) -> np.ndarray:
    return lo + np.arange(grid) * (hi - lo) / (grid - 1) if lo < hi else np.array([lo])


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, lf: np.ndarray, scales: tuple[float, float], alphas: tuple[float, float], grid: int = GRID, passes: int = PASSES) -> tuple[float, float, float, float]:
    """(alpha, scale, amplitude, delta_chi2) of the best template."""
    (s0, s1), (a0, a1) = scales, alphas
    best = None
    for _ in range(passes):
        at_scale, at_alpha = _points(s0, s1, grid), _points(a0, a1, grid)
        falls = np.exp(-x[None, :] / at_scale[:, None])
        colour = np.exp(-at_alpha[:, None] * lf[None, :])
        num = (colour * (w * y)) @ falls.T
        den = (colour * colour * w) @ (falls * falls).T
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(den > 0, num * num / den, -np.inf)
        j, i = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = float(at_alpha[j]), float(at_scale[i]), float(num[j, i] / den[j, i]) if den[j, i] > 0 else np.nan, float(gain[j, i])
        (a0, a1), (s0, s1) = _narrow(a0, a1, best[0], grid), _narrow(s0, s1, best[1], grid)
    return best


def fit_decay(rows: DataFrame, keys: list[str], *, scales: tuple[float, float], alphas: tuple[float, float] | None, fixed_alpha: bool = False, rows_in_task: int = ROWS_IN_TASK, grid: int = GRID, passes: int = PASSES) -> DataFrame:
    """(keys, alpha, scale, amp, delta_chi2) per group of rows with columns _x, _y, _w, _lf (log frequency).

    ``alphas`` None means no frequency dependence; ``fixed_alpha`` takes alpha
    from the column _alpha instead.  Groups of more than ``rows_in_task`` rows
    are fitted together: every pass sums the templates of all grid points over
    the rows, in arrays on the map side, and narrows each group's grid.
    """
    sizes = small(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_lf").alias("_mid")))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    out_schema = f"{fields}, alpha double, scale double, amp double, delta_chi2 double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w, lf = (pdf[c].to_numpy(float) for c in ("_x", "_y", "_w", "_lf"))
        mid = float(pdf["_mid"].iloc[0])
        alpha = (float(pdf["_alpha"].iloc[0]),) * 2 if fixed_alpha else alphas or (0.0, 0.0)
        a, s, amp, d = _fit(x, y, w, lf - mid, scales, alpha, grid, passes)
        return pdf[keys].head(1).assign(alpha=a, scale=s, amp=amp * np.exp(a * mid), delta_chi2=d)

    short = rows.join(sizes.where(F.col("_n") <= rows_in_task).drop("_n"), keys).groupBy(*keys).applyInPandas(one, out_schema)
    long = sizes.where(F.col("_n") > rows_in_task).drop("_n")
    if long.isEmpty():
        return short
    big = rows.join(long, keys)
    lo_a, hi_a = (F.min("_alpha"), F.max("_alpha")) if fixed_alpha else (F.lit(alphas[0] if alphas else 0.0), F.lit(alphas[1] if alphas else 0.0))
    box = big.groupBy(*keys).agg(lo_a.alias("a0"), hi_a.alias("a1"), F.lit(float(scales[0])).alias("s0"), F.lit(float(scales[1])).alias("s1"), F.first("_mid").alias("_mid"))
    spots = [(j, i) for j in range(grid) for i in range(grid)]
    for _ in range(passes):
        box = small(box)
        at = big.drop("_mid").join(box, keys)
        da, ds = (F.col("a1") - F.col("a0")) / (grid - 1), (F.col("s1") - F.col("s0")) / (grid - 1)
        fall = lambda i: F.exp(-F.col("_x") / (F.col("s0") + i * ds))
        shade = lambda j: F.exp(-(F.col("a0") + j * da) * (F.col("_lf") - F.col("_mid")))
        at = at.select(*keys, "a0", "a1", "s0", "s1", "_mid", "_w", "_y", *[fall(i).alias(f"_s{i}") for i in range(grid)], *[shade(j).alias(f"_c{j}") for j in range(grid)])
        f = lambda j, i: F.col(f"_c{j}") * F.col(f"_s{i}")
        sums = at.groupBy(*keys, "a0", "a1", "s0", "s1", "_mid").agg(
            *[F.sum(F.col("_w") * F.col("_y") * f(j, i)).alias(f"_n{j}_{i}") for j, i in spots], *[F.sum(F.col("_w") * f(j, i) * f(j, i)).alias(f"_d{j}_{i}") for j, i in spots]
        )
        # one small row per group from here on; of equal gains the first point counts, as in one task
        point = lambda k, j, i: F.struct(
            F.when(F.col(f"_d{j}_{i}") > 0, F.col(f"_n{j}_{i}") * F.col(f"_n{j}_{i}") / F.col(f"_d{j}_{i}")).otherwise(F.lit(float("-inf"))).alias("gain"), F.lit(-k).alias("first"),
            (F.col("a0") + j * da).alias("alpha"), (F.col("s0") + i * ds).alias("scale"), F.try_divide(F.col(f"_n{j}_{i}"), F.col(f"_d{j}_{i}")).alias("amp"),
        )
        best = small(sums.withColumn("_t", F.array_max(F.array(*[point(k, j, i) for k, (j, i) in enumerate(spots)]))).select(*keys, "a0", "a1", "s0", "s1", "_mid", "_t"))
        box = best.select(
            *keys, F.greatest("a0", F.col("_t.alpha") - da).alias("a0"), F.least("a1", F.col("_t.alpha") + da).alias("a1"),
            F.greatest("s0", F.col("_t.scale") - ds).alias("s0"), F.least("s1", F.col("_t.scale") + ds).alias("s1"), "_mid",
        )
    done = best.select(*keys, F.col("_t.alpha").alias("alpha"), F.col("_t.scale").alias("scale"), (F.col("_t.amp") * F.exp(F.col("_t.alpha") * F.col("_mid"))).alias("amp"), F.col("_t.gain").alias("delta_chi2"))
    return short.unionByName(done)


def _rows(df: DataFrame, keep: list[str], x: Column, freq_dependence: bool, resid: str, sigma: str, freq: str) -> DataFrame:
    ok = x.isNotNull() & F.col(resid).isNotNull() & (F.col(sigma) > 0)
    if freq_dependence:
        ok = ok & F.col(freq).isNotNull() & (F.col(freq) > 0)
    lf = F.log(freq) if freq_dependence else F.lit(0.0)
    return df.where(ok).select(*keep, x.alias("_x"), F.col(resid).alias("_y"), (F.lit(1.0) / (F.col(sigma) * F.col(sigma))).alias("_w"), lf.alias("_lf"))


def detect_solar(df: DataFrame, keys: list[str], cfg: Options = options("solar", on=True), *, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", time: str = "mjd", elongation: str = "solar_elongation_deg") -> DataFrame:
    """Adds solar_event_member, _year, _amp, _tau, _alpha, _delta_chi2.

    alpha comes from the whole series; scale and amplitude are fitted anew for
    years with enough rows, some of them near the sun, and taken from the whole
    elsewhere.  A series with too few rows has no event.
    """
    p = "solar_event"
    alphas = cfg.colour_range if cfg.colour else None
    how = dict(scales=cfg.scale_range)
    dated = df.withColumn(f"{p}_year", year_of_mjd(F.col(time)))
    rows = _rows(dated, [*keys, f"{p}_year"], F.col(elongation), cfg.colour, resid, sigma, freq)
    enough = small(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.points).drop("_n"))
    rows = rows.join(enough, keys, "left_semi")
    whole = small(fit_decay(rows, keys, alphas=alphas, **how))
    near = F.count_if(F.col("_x") <= cfg.near_deg) >= cfg.points_near
    years = small(rows.groupBy(*keys, f"{p}_year").agg((F.count("*") >= cfg.points_year).alias("_a"), near.alias("_b")).where("_a and _b").drop("_a", "_b"))
    by_year = rows.join(years, [*keys, f"{p}_year"], "left_semi").join(whole.select(*keys, F.col("alpha").alias("_alpha")), keys)
    yearly = fit_decay(by_year, [*keys, f"{p}_year"], alphas=None, fixed_alpha=True, **how)
    yearly = yearly.select(*keys, f"{p}_year", *[F.col(c).alias(f"_y_{c}") for c in ("amp", "scale", "delta_chi2")])
    out = dated.join(whole, keys, "left").join(small(yearly), [*keys, f"{p}_year"], "left")
    both = lambda c: F.coalesce(f"_y_{c}", c)
    out = out.withColumns({f"{p}_amp": both("amp"), f"{p}_tau": both("scale"), f"{p}_alpha": F.col("alpha"), f"{p}_delta_chi2": both("delta_chi2")})
    model = F.abs(f"{p}_amp") * F.exp(-F.col(elongation) / F.col(f"{p}_tau"))
    if cfg.colour:
        model = model * F.pow(F.when(F.col(freq) > 0, F.col(freq)), -F.col(f"{p}_alpha"))
    member = F.coalesce(model / F.when(F.col(sigma) > 0, F.col(sigma)) >= cfg.eta, F.lit(False))
    return out.withColumn(f"{p}_member", member).drop("alpha", "scale", "amp", "delta_chi2", "_y_amp", "_y_scale", "_y_delta_chi2")


def detect_eclipse(df: DataFrame, keys: list[str], cfg: Options = options("eclipse", on=True), *, resid: str = "resid", sigma: str = "sigma", freq: str = "freq", phase: str = "orbital_phase") -> DataFrame:
    """Adds eclipse_event_member, _amp, _width, _alpha, _delta_chi2 from the distance to the centre phase."""
    p = "eclipse_event"
    x = folded_distance(F.pmod(F.col(phase), F.lit(1.0)), cfg.centre)
    rows = _rows(df, keys, x, cfg.colour, resid, sigma, freq)
    enough = small(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.points).drop("_n"))
    alphas = cfg.colour_range if cfg.colour else None
    fit = fit_decay(rows.join(enough, keys, "left_semi"), keys, scales=cfg.scale_range, alphas=alphas)
    named = fit.select(*keys, F.col("amp").alias(f"{p}_amp"), F.col("scale").alias(f"{p}_width"), F.col("alpha").alias(f"{p}_alpha"), F.col("delta_chi2").alias(f"{p}_delta_chi2"))
    out = with_group_value(df, named, keys)
    model = F.abs(f"{p}_amp") * F.exp(-x / F.col(f"{p}_width"))
    if cfg.colour:
        model = model * F.pow(F.when(F.col(freq) > 0, F.col(freq)), -F.col(f"{p}_alpha"))
    return out.withColumn(f"{p}_member", F.coalesce(model / F.when(F.col(sigma) > 0, F.col(sigma)) >= cfg.eta, F.lit(False)))
