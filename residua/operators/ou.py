"""Correlated-noise innovations and bad days."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.session import checkpointed
from residua.functions.stats import fdr_flags, normal_two_sided
from residua.operators.blocks import exact_median, previous_rows, small


def innovations(df: DataFrame, keys: list[str], *, tau: float, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id") -> DataFrame:
    """Adds ou_e, ou_a, ou_b with variance a + q b: e = y - phi y_prev, a = s^2 + phi^2 s_prev^2, b = 1 - phi^2.

    The first row of a series has e = y, a = s^2, b = 1.  Rows that lack time,
    value or sigma have nulls and are no row's predecessor.
    """
    ok = F.col(time).isNotNull() & F.col(resid).isNotNull() & F.col(sigma).isNotNull()
    out = previous_rows(df.where(ok), keys, time, row_id, [time, resid, sigma])
    first = F.col(f"prev_{time}").isNull()
    phi = F.exp(-(F.col(time) - F.col(f"prev_{time}")) / F.lit(tau)) if tau > 0 else F.lit(0.0)
    out = out.withColumn("_phi", F.when(first, F.lit(0.0)).otherwise(phi))
    made = out.withColumns({
        "ou_e": F.when(first, F.col(resid)).otherwise(F.col(resid) - F.col("_phi") * F.col(f"prev_{resid}")),
        "ou_a": F.when(first, F.pow(sigma, F.lit(2))).otherwise(F.pow(sigma, F.lit(2)) + F.pow("_phi", F.lit(2)) * F.pow(f"prev_{sigma}", F.lit(2))),
        "ou_b": F.lit(1.0) - F.col("_phi") * F.col("_phi"),
    }).drop("_phi", f"prev_{time}", f"prev_{resid}", f"prev_{sigma}")
    return made.unionByName(df.where(~ok), allowMissingColumns=True)


def _spread(z: np.ndarray) -> float:
    mad = float(np.median(np.abs(z - np.median(z))))
    return 1.4826 * mad if mad > 0 else float(np.std(z))


#: points of the grid that narrows around q, and how often it does (to 1e-9 of its range)
STEPS, PASSES = 8, 10


def fit_q(e: np.ndarray, a: np.ndarray, b: np.ndarray, s2: np.ndarray) -> float:
    """The q in [0, 100 median(s^2)] at which the robust spread of e/sqrt(a + q b) first is no more than 1."""
    ok = np.isfinite(e) & np.isfinite(a) & np.isfinite(b)
    e, a, b = e[ok], a[ok], b[ok]
    spread = lambda q: _spread(e / np.sqrt(np.maximum(a + q * b, 1e-300)))
    if len(e) < 10 or spread(0.0) <= 1:
        return 0.0
    low, high = 0.0, 100.0 * float(np.median(s2[np.isfinite(s2)]))
    if spread(high) > 1:
        return high
    for _ in range(PASSES):
        step = (high - low) / STEPS
        k = next((k for k in range(1, STEPS) if spread(low + k * step) <= 1), STEPS)
        low, high = low + (k - 1) * step, low + k * step if k < STEPS else high
    return (low + high) / 2


def noise_strength(with_innovations: DataFrame, keys: list[str], *, sigma: str = "sigma", rows_in_task: int = 2_000_000) -> DataFrame:
    """(keys, q_hat) for each series.

    Series of at most ``rows_in_task`` rows are fitted each in one task.  Longer
    ones are fitted together by passes over all rows: every pass takes the exact
    spread at the points of the grid and keeps the interval in which it falls to
    1.  Both look at the same points and give the same q.
    """
    src = with_innovations.where(F.col("ou_e").isNotNull()).select(*keys, "ou_e", "ou_a", "ou_b", (F.col(sigma) * F.col(sigma)).alias("_s2"))
    sizes = small(src.groupBy(*keys).agg(F.count("*").alias("_n")))
    long = sizes.where(F.col("_n") > rows_in_task)
    out_type = src.select(*keys).schema.simpleString()[7:-1].replace(":", " ")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        q = fit_q(*(pdf[c].to_numpy(float) for c in ("ou_e", "ou_a", "ou_b", "_s2")))
        return pdf[keys].head(1).assign(q_hat=q)

    short = src.join(sizes.where(F.col("_n") <= rows_in_task).drop("_n"), keys, "left_semi").groupBy(*keys).applyInPandas(one, f"{out_type}, q_hat double")
    if long.isEmpty():
        return short
    rows = src.join(long.drop("_n"), keys, "left_semi")
    largest = long.agg(F.max("_n")).first()[0]

    def spreads(grid: DataFrame) -> DataFrame:
        """keys, _i, _q and the exact spread at it."""
        by = [*keys, "_i"]
        z = rows.join(grid, keys).select(*by, "_q", (F.col("ou_e") / F.sqrt(F.greatest(F.col("ou_a") + F.col("_q") * F.col("ou_b"), F.lit(1e-300)))).alias("_z"))
        mid = small(exact_median(z, by, "_z", "_m", direct_rows=rows_in_task, largest=largest))
        off = z.join(mid, by).withColumn("_d", F.abs(F.col("_z") - F.col("_m")))
        mad = exact_median(off, by, "_d", "_mad", direct_rows=rows_in_task, largest=largest)
        flat = z.groupBy(*by, "_q").agg(F.stddev_pop("_z").alias("_sd"))
        return small(flat.join(mad, by).select(*by, "_q", F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd")).alias("_s")))

    top = exact_median(rows, keys, "_s2", "_m2", direct_rows=rows_in_task, largest=largest).select(*keys, (100.0 * F.col("_m2")).alias("_hi"))
    ends = small(top.withColumn("_lo", F.lit(0.0)))
    at_ends = spreads(small(ends.select(*keys, F.posexplode(F.array("_lo", "_hi")).alias("_i", "_q"))))
    edge = at_ends.groupBy(*keys).agg(F.max(F.when(F.col("_i") == 0, F.col("_s"))).alias("_s0"), F.max(F.when(F.col("_i") == 1, F.col("_s"))).alias("_s1"))
    state = ends.join(edge, keys).withColumn("_fixed", F.when(F.col("_s0") <= 1, F.lit(0.0)).when(F.col("_s1") > 1, F.col("_hi")))
    bounds = small(state.select(*keys, F.coalesce("_fixed", "_lo").alias("_lo"), F.coalesce("_fixed", "_hi").alias("_hi")))
    for _ in range(PASSES):
        step = (F.col("_hi") - F.col("_lo")) / STEPS
        inner = F.transform(F.sequence(F.lit(1), F.lit(STEPS - 1)), lambda i: F.struct(i.alias("i"), (F.col("_lo") + i * step).alias("q")))
        grid = bounds.where("_lo < _hi").select(*keys, F.explode(inner).alias("_p")).select(*keys, F.col("_p.i").alias("_i"), F.col("_p.q").alias("_q"))
        first = spreads(small(grid)).groupBy(*keys).agg(F.min(F.when(F.col("_s") <= 1, F.col("_i"))).alias("_k"))
        k = F.coalesce("_k", F.lit(STEPS))
        moved = bounds.join(first, keys, "left")
        bounds = small(moved.select(*keys, F.when(F.col("_lo") < F.col("_hi"), F.col("_lo") + (k - 1) * step).otherwise(F.col("_lo")).alias("_lo"), F.when((k < STEPS) & (F.col("_lo") < F.col("_hi")), F.col("_lo") + k * step).otherwise(F.col("_hi")).alias("_hi")))
    return short.unionByName(bounds.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("q_hat")))


def bad_days(df: DataFrame, keys: list[str], *, z: Column | str, fdr_q: float, only_worst: bool, day: str = "day", row_id: str = "toa_id", time: str = "mjd") -> DataFrame:
    """Adds bad_day and bad from each day's largest |z| under a false-discovery rate per series."""
    zed = F.col(z) if isinstance(z, str) else z
    rows = df.withColumn("_az", F.abs(zed))
    worst = F.struct(F.col("_az"), (-F.col(time)).alias("t"), (-F.col(row_id)).alias("i"))
    days = rows.groupBy(*keys, day).agg(F.max(F.when(F.col("_az").isNotNull(), worst)).alias("_w"))
    days = days.select(*keys, day, normal_two_sided(F.col("_w._az")).alias("_p"), (-F.col("_w.i")).alias("_row"))
    days = fdr_flags(days, keys, "_p", fdr_q, "_flag").where("_flag").select(*keys, day, "_row")
    out = rows.join(small(days), [*keys, day], "left")
    bad = F.col("_row").isNotNull()
    return out.withColumn("bad_day", bad).withColumn("bad", bad & (F.col("_row") == F.col(row_id)) if only_worst else bad).drop("_az", "_row").withColumn("bad", F.coalesce("bad", F.lit(False)))


def detect_bad(df: DataFrame, keys: list[str], cfg: Options = options("noise"), *, resid: str = "resid", sigma: str = "sigma", made: DataFrame | None = None) -> DataFrame:
    """Adds z, _q_hat, bad_day and bad; ``made``: the stored rows with their innovations, where these are there already."""
    if made is None:
        made = checkpointed(innovations(df, keys, tau=cfg.tau_days, resid=resid, sigma=sigma))  # read for the sizes, the fit and the result
    q = noise_strength(made, keys, sigma=sigma)
    out = made.join(small(q), keys, "left").withColumnRenamed("q_hat", "_q_hat")
    out = out.withColumn("z", F.col("ou_e") / F.nullif(F.sqrt(F.col("ou_a") + F.coalesce("_q_hat", F.lit(0.0)) * F.col("ou_b")), F.lit(0.0)))
    return bad_days(out, keys, z="z", fdr_q=cfg.fdr, only_worst=cfg.worst_only).drop("ou_e", "ou_a", "ou_b")
