"""Covariate columns of timing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.functions.geometry import clip, geodetic, horizon, solar_elongation
from residua.operators.blocks import ranked, small
from residua.operators.outliers import with_group_value
from residua.sources.par import ParFile, sky_position


def orbital_phase(mjd: Column, pb: float | None, t0: float | None) -> Column:
    """Phase in [0, 1) of period pb days since t0; null without a positive period or an epoch."""
    if pb is None or t0 is None or pb <= 0:
        return F.lit(None).cast("double")
    return F.pmod((mjd - F.lit(float(t0))) / F.lit(float(pb)), F.lit(1.0))


def freq_bins(df: DataFrame, keys: list[str], *, freq: str = "freq", bins: int = 8, out: str = "freq_bin") -> DataFrame:
    """Adds the bin of freq among ``bins`` even bins of the range of each series.

    One value only gives bin 0; a null frequency in a series with a range the
    top bin; a series without any frequency null.
    """
    per = df.groupBy(*keys).agg(F.min(freq).alias("_lo"), F.max(freq).alias("_hi"))
    at = with_group_value(df, per, keys)
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, F.col("_hi")).otherwise(i * step + F.col("_lo")))
    found = F.greatest(F.lit(0), F.least(F.size(F.filter(edges, lambda e: e <= F.col(freq))) - 1, F.lit(bins - 1)))
    value = F.when(F.col("_lo").isNull(), None).when(F.col("_lo") == F.col("_hi"), F.lit(0)).when(F.col(freq).isNull(), F.lit(bins - 1)).otherwise(found)
    return at.withColumn(out, value.cast("int")).drop("_lo", "_hi")


def with_sites(df: DataFrame, sites: DataFrame, *, tel: str = "tel") -> DataFrame:
    """Adds site_x, site_y, site_z by the lower-cased, trimmed telescope name; null for unknown ones.

    ``sites`` has name, x, y, z, one row per name.
    """
    named = small(sites.select(F.col("name").alias("_site"), F.col("x").alias("site_x"), F.col("y").alias("site_y"), F.col("z").alias("site_z")))
    return df.join(named, F.lower(F.trim(F.col(tel))) == F.col("_site"), "left").drop("_site")


def aligned_by_order(df: DataFrame, values: DataFrame, *, time: str = "mjd", row_id: str = "toa_id", value_time: str = "sat", value: str = "angle", out: str = "solar_elongation_deg") -> DataFrame:
    """Zips rows with values given in another order: the k-th in time takes the k-th value in time.

    Raises if the counts differ.  Places are counted within ranges of the order
    and moved by the counts of the ranges before, so no task sees all rows.
    """
    left, n = ranked(df, [time, row_id], "_k")
    right, m = ranked(values.select(F.col(value_time), F.col(value).alias(out)), [value_time, out], "_k")
    if n != m:
        raise ValueError(f"{m} values for {n} rows")
    return left.join(right.select("_k", out), "_k").drop("_k")


def add_features(df: DataFrame, par: ParFile, cfg: Options = options("covariates"), *, sites: DataFrame | None = None, series: list[str] | None = None, mjd: str = "mjd", tel: str = "tel") -> DataFrame:
    """Adds the covariates that ``cfg`` asks for; what the par file or the sites cannot give is null.

    A column solar_elongation_deg that is there already is kept, clipped to 0..180.
    """
    t, out = F.col(mjd), df
    none = F.lit(None).cast("double")
    if cfg.phase:
        out = out.withColumn("orbital_phase", orbital_phase(t, par.number("PB"), par.number("T0", "TASC")))
    position = sky_position(par)
    if cfg.elongation:
        if "solar_elongation_deg" in df.columns:
            angle = clip(F.col("solar_elongation_deg"), 0.0, 180.0)
        else:
            angle = solar_elongation(t, F.lit(position[0]), F.lit(position[1])) if position else none
        out = out.withColumn("solar_elongation_deg", angle)
    wanted = {"elevation_deg": cfg.elevation, "airmass": cfg.airmass, "parallactic_angle_deg": cfg.parallactic}
    if any(wanted.values()):
        if position and sites is not None and tel in df.columns:
            out = with_sites(out, sites, tel=tel)
            lon, lat = geodetic(F.col("site_x"), F.col("site_y"), F.col("site_z"))
            made = horizon(t, F.lit(position[0]), F.lit(position[1]), lon, lat)
            out = out.withColumns({n: made[n] for n, on in wanted.items() if on}).drop("site_x", "site_y", "site_z")
        else:
            out = out.withColumns({n: none for n, on in wanted.items() if on})
    if cfg.freq_bins:
        out = freq_bins(out, series or [], bins=cfg.freq_bins)
    return out
