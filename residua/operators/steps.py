"""Step changes of level, achromatic or scaling with 1/freq^2."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.operators.blocks import DIRECT_ROWS, SMALL, exact_median, in_blocks, largest_group, small
from residua.session import stored


def chromatic_scale(freq: str = "freq") -> Column:
    """freq^2 where it is usable, else null."""
    f = F.col(freq)
    return F.when(f.isNotNull() & (f != 0), f * f)


def fitted(resid: str, sigma: str, time: str, scale: Column | None) -> tuple[Column, Column]:
    """Value and weight of a row; either is null where the row cannot be fitted."""
    k = scale if scale is not None else F.lit(1.0)
    y, s = F.col(resid) * k, F.col(sigma) * k
    return y, F.when(s > 0, F.lit(1.0) / (s * s))


def usable(df: DataFrame, resid: str, sigma: str, time: str, scale: Column | None) -> DataFrame:
    """Adds _y and _w of rows that can be fitted; other rows are left out."""
    y, w = fitted(resid, sigma, time, scale)
    return df.withColumns({"_y": y, "_w": w}).where(F.col(time).isNotNull() & F.col("_y").isNotNull() & F.col("_w").isNotNull())


def best_steps(
    df: DataFrame, keys: list[str], cfg: Options = options("step"), *, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", row_id: str = "toa_id", scale: Column | None = None
) -> DataFrame:
    """(keys, t0, amp, delta_chi2) of the best split of each series that reaches the threshold.

    Splits are scanned by running sums of weights; the earliest of equal splits
    wins.  A series without an accepted split has no row.
    """
    return best_steps_of(df, keys, {"one": Scan(cfg, resid, sigma, scale)}, time=time, row_id=row_id)["one"]


class Scan(NamedTuple):
    """One of the scans that share a pass over the rows."""

    cfg: Options
    resid: str = "resid"
    sigma: str = "sigma"
    scale: Column | None = None


def best_steps_of(df: DataFrame, keys: list[str], scans: dict[str, Scan], *, time: str = "mjd", row_id: str = "toa_id") -> dict[str, DataFrame]:
    """``best_steps`` of several values of the same rows, which are sorted once.

    Sums run within (series, time block); what earlier blocks contribute comes
    from a table of one row per block.
    """
    fits = {}
    for i, c in scans.items():
        y, w = fitted(c.resid, c.sigma, time, c.scale)
        ok = y.isNotNull() & w.isNotNull()
        fits |= {f"_y_{i}": F.when(ok, y), f"_w_{i}": F.when(ok, w)}
    rows = in_blocks(df.where(F.col(time).isNotNull()).select(*keys, row_id, F.col(time).alias("_t"), *[c.alias(n) for n, c in fits.items()]), "_t")
    t = lambda i: F.when(F.col(f"_w_{i}").isNotNull(), F.col("_t"))
    sums = {f"{k}_{i}": c for i in scans for k, c in (("n", F.when(F.col(f"_w_{i}").isNotNull(), F.lit(1))), ("sw", F.col(f"_w_{i}")), ("swy", F.col(f"_w_{i}") * F.col(f"_y_{i}")))}
    per = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[f(t(i)).alias(f"{k}_{i}") for i in scans for k, f in (("first", F.min), ("last", F.max))])
    series = Window.partitionBy(*keys)
    before = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = small(per.select(
        *keys, "_block",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(n).over(series).alias(f"_all_{n}") for n in sums],
        *[c.alias(f"_{k}_{i}") for i in scans for k, c in (("carry", F.max(f"last_{i}").over(before)), ("first", F.min(f"first_{i}").over(series)), ("last", F.max(f"last_{i}").over(series)))],
    ))
    order = Window.partitionBy(*keys, "_block").orderBy("_t", row_id)
    local, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in sums.items()} | {f"_prev_{i}": F.max(t(i)).over(above) for i in scans})
    run = run.join(per, [*keys, "_block"])
    best = []
    for i, c in scans.items():
        n, sw, swy = (F.coalesce(F.col(f"_l_{k}_{i}"), F.lit(0)) + F.col(f"_b_{k}_{i}") for k in ("n", "sw", "swy"))
        all_n, all_w, all_wy = (F.col(f"_all_{k}_{i}") for k in ("n", "sw", "swy"))
        w, y, prev = F.col(f"_w_{i}"), F.col(f"_y_{i}"), F.coalesce(f"_prev_{i}", f"_carry_{i}")
        w1, wy1 = sw - w, swy - w * y
        w2 = all_w - sw + w
        amp = (all_wy - wy1) / w2 - wy1 / w1
        t0 = (prev + F.col("_t")) / 2
        ok = w.isNotNull() & (n - 1 >= c.cfg.points) & (all_n - n + 1 >= c.cfg.points)
        if c.cfg.span_days is not None:
            end = F.col(f"_last_{i}") if c.cfg.horizon_days is None else F.least(F.col(f"_last_{i}"), t0 + c.cfg.horizon_days)
            ok = ok & (prev - F.col(f"_first_{i}") >= c.cfg.span_days) & (end - F.col("_t") >= c.cfg.span_days)
        split = F.when(ok, F.struct((amp * amp / (1 / w1 + 1 / w2)).alias("d"), (-n).alias("n"), t0.alias("t0"), amp.alias("amp")))
        best.append(F.max(split).alias(f"_best_{i}"))
    found = small(run.groupBy(*keys).agg(*best))
    at = lambda i, f: F.col(f"_best_{i}.{f}")
    return {i: found.where(at(i, "d") >= c.cfg.gain).select(*keys, at(i, "t0").alias("t0"), at(i, "amp").alias("amp"), at(i, "d").alias("delta_chi2")) for i, c in scans.items()}


def step_members(df: DataFrame, events: DataFrame, keys: list[str], cfg: Options, *, prefix: str, sigma: str = "sigma", time: str = "mjd", scale: Column | None = None, count_keys: list[str] | None = None, into: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Adds the step columns: who is after the step within the horizon, and for whom it is larger than eta sigma.

    ``events`` has one row per ``keys``.  Counts are over ``count_keys``
    (default ``keys``); they are made only where they are read.  The columns go
    to ``into``, the same rows with further columns, where it is given.
    ``largest`` is a bound on the rows of a group where it is known.
    """
    ev, size = stored(events.select(*keys, F.col("t0").alias(f"{prefix}_t0"), F.col("amp").alias(f"{prefix}_amp"), F.col("delta_chi2").alias(f"{prefix}_delta_chi2")))
    counted = count_keys or keys
    t0, t = F.col(f"{prefix}_t0"), F.col(time)
    inside = t >= t0
    if cfg.horizon_days is not None:
        inside = inside & (t <= t0 + F.lit(float(cfg.horizon_days)))
    known = F.col(f"{prefix}_amp").isNotNull()
    effect = F.abs(f"{prefix}_amp") / (scale if scale is not None else F.lit(1.0))
    z = F.when(F.col(f"{prefix}_applicable") & (F.col(sigma) > 0), effect / F.col(sigma))

    def placed(rows: DataFrame) -> DataFrame:
        at = rows.join(F.broadcast(ev) if size <= SMALL else ev, keys, "left")
        at = at.withColumn(f"{prefix}_applicable", F.coalesce(known & inside, F.lit(False)))
        at = at.withColumn("_z", z).withColumn(f"{prefix}_informative", F.coalesce(F.col("_z") > cfg.eta, F.lit(False)))
        return at.withColumn(f"{prefix}_id", F.when(F.col(f"{prefix}_applicable"), F.lit(0)).otherwise(F.lit(-1)))

    rows = placed(df).where(F.col(f"{prefix}_applicable"))
    zi = F.when(F.col(f"{prefix}_informative"), F.col("_z"))
    direct = (largest_group(df, counted) if largest is None else largest) <= DIRECT_ROWS
    stats = rows.groupBy(*counted).agg(
        F.count("*").alias(f"{prefix}_n_applicable"),
        F.count(zi).alias(f"{prefix}_n_informative"),
        F.count(zi).alias(f"{prefix}_n_members"),
        F.coalesce(F.avg((zi < 1).cast("double")), F.lit(0.0)).alias(f"{prefix}_frac_informative_z_lt1"),
        F.coalesce(F.avg((zi < 1).cast("double")), F.lit(0.0)).alias(f"{prefix}_frac_z_lt1"),
        F.min(zi).alias(f"{prefix}_z_min"),
        F.max(zi).alias(f"{prefix}_z_max"),
        *[F.median(zi).alias(f"{prefix}_z_med")] * direct,
    )
    if not direct:
        stats = small(stats.join(exact_median(rows.where(F.col(f"{prefix}_informative")), counted, "_z", f"{prefix}_z_med", largest=largest), counted, "left"))
    elif counted == keys and size <= SMALL / 8:  # at most a row for each event
        stats = F.broadcast(stats)
    out = placed(df if into is None else into).drop("_z").join(stats, counted, "left")
    zero = [f"{prefix}_n_applicable", f"{prefix}_n_informative", f"{prefix}_n_members", f"{prefix}_frac_informative_z_lt1", f"{prefix}_frac_z_lt1"]
    return out.fillna(0, subset=zero)


def detect_step(df: DataFrame, keys: list[str], cfg: Options = options("step"), *, prefix: str = "step", resid: str = "resid", sigma: str = "sigma") -> DataFrame:
    return step_members(df, best_steps(df, keys, cfg, resid=resid, sigma=sigma), keys, cfg, prefix=prefix, sigma=sigma)


def detect_dm_step(df: DataFrame, keys: list[str], cfg: Options = options("step"), *, prefix: str = "dm_step", resid: str = "resid", sigma: str = "sigma", freq: str = "freq") -> DataFrame:
    """The same on y freq^2; the effect on a row is amp / freq^2."""
    k = chromatic_scale(freq)
    return step_members(df, best_steps(df, keys, cfg, resid=resid, sigma=sigma, scale=k), keys, cfg, prefix=prefix, sigma=sigma, scale=k)


def regroup_step(df: DataFrame, events: DataFrame, series: list[str], group: str, cfg: Options, *, resid: str = "resid", sigma: str = "sigma", time: str = "mjd", scale: Column | None = None) -> DataFrame:
    """(series, group, t0, amp, delta_chi2): the amplitude of each series' step estimated anew in every group.

    t0 and delta_chi2 stay those of the series.  Groups with fewer than
    min_points rows on a side have no row.
    """
    rows = usable(df, resid, sigma, time, scale).join(small(events.select(*series, "t0", "delta_chi2")), series)
    t = F.col(time)
    post = t >= F.col("t0")
    if cfg.horizon_days is not None:
        post = post & (t <= F.col("t0") + F.lit(float(cfg.horizon_days)))
    pre = t < F.col("t0")
    w, wy = F.col("_w"), F.col("_w") * F.col("_y")
    per = rows.groupBy(*series, group).agg(
        F.max("t0").alias("t0"), F.max("delta_chi2").alias("delta_chi2"),
        F.count_if(pre).alias("_n1"), F.count_if(post).alias("_n2"),
        F.sum(F.when(pre, w)).alias("_w1"), F.sum(F.when(pre, wy)).alias("_y1"),
        F.sum(F.when(post, w)).alias("_w2"), F.sum(F.when(post, wy)).alias("_y2"),
    )
    ok = per.where((F.col("_n1") >= cfg.points) & (F.col("_n2") >= cfg.points))
    return ok.select(*series, group, "t0", (F.col("_y2") / F.col("_w2") - F.col("_y1") / F.col("_w1")).alias("amp"), "delta_chi2")


def detect_global_step(df: DataFrame, series: list[str], group: str, cfg: Options, *, prefix: str = "step_global", resid: str = "resid", sigma: str = "sigma", scale: Column | None = None, events: DataFrame | None = None, into: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """A step found in the whole series, its amplitude and members per group."""
    found = small(best_steps(df, series, cfg, resid=resid, sigma=sigma, scale=scale)) if events is None else events
    per = regroup_step(df, found, series, group, cfg, resid=resid, sigma=sigma, scale=scale)
    return step_members(df, per, [*series, group], cfg, prefix=prefix, sigma=sigma, scale=scale, into=into, largest=largest)
