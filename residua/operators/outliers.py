"""Threshold outliers: robust z, the dynamic hard limit and the sigma gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.options import Options
from residua.operators.blocks import exact_median, largest_group, small


def with_group_value(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of one row per group, broadcast when it is counted to be small."""
    return with_value(df, small(values) if keys else values, keys)


def with_value(df: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """The same for values that are written already."""
    return df.join(values, keys, "left") if keys else df.crossJoin(F.broadcast(values.limit(1)))


def robust_outliers(df: DataFrame, keys: list[str], *, resid: str = "resid", z_thresh: float = 5.0, prefix: str = "robust", into: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Adds <prefix>_z = 0.6745 (y - median)/MAD of the group and <prefix>_outlier = |z| >= z_thresh.

    Groups with MAD 0 and rows without a value have a null z and no outlier.
    The columns go to ``into``, the same rows with further columns, where it is
    given.  ``largest`` is a bound on the rows of a group where it is known.
    """
    largest = largest_group(df.where(F.col(resid).isNotNull()), keys) if largest is None else largest
    med = exact_median(df, keys, resid, "_med", largest=largest)
    med = small(med) if keys else med
    at = with_value(df, med, keys).withColumn("_dev", F.abs(F.col(resid) - F.col("_med")))
    mad = exact_median(at, keys, "_dev", "_mad", largest=largest)
    out = with_group_value(at if into is None else with_value(into, med, keys), mad, keys)
    z = F.lit(0.6745) * (F.col(resid) - F.col("_med")) / F.nullif(F.col("_mad"), F.lit(0.0))
    return (
        out.withColumn(f"{prefix}_z", z)
        .withColumn(f"{prefix}_outlier", F.coalesce(F.abs(f"{prefix}_z") >= z_thresh, F.lit(False)))
        .drop("_med", "_dev", "_mad")
    )


def hard_limit(df: DataFrame, keys: list[str], *, resid: str = "resid", sigma: str = "sigma", factor: float = 4.0, label: str = "BAD_DM_DVT+20", into: DataFrame | None = None) -> DataFrame:
    """Adds bad_dm_dvt with its k, score and label: |r|/s above factor * max(1, mean score of the keys)."""
    scored = lambda rows: rows.withColumn("bad_dm_dvt_score", F.abs(F.col(resid)) / F.when(F.col(sigma) > 0, F.col(sigma)))
    mean = scored(df).groupBy(*keys).agg(F.greatest(F.lit(1.0), F.coalesce(F.avg("bad_dm_dvt_score"), F.lit(1.0))).alias("bad_dm_dvt_k"))
    out = with_group_value(scored(df if into is None else into), mean, keys)
    out = out.withColumn("bad_dm_dvt", F.coalesce(F.col("bad_dm_dvt_score") > factor * F.col("bad_dm_dvt_k"), F.lit(False)))
    return out.withColumn("bad_dm_dvt_label", F.when(F.col("bad_dm_dvt"), F.lit(label)).otherwise(F.lit("")))


def sigma_gate(df: DataFrame, cfg: Options, *, resid: str = "resid", sigma: str = "sigma") -> DataFrame:
    """Adds outlier_gate_* and bad_hard; rows inside the gate lose their OU and MAD flags, where they have them."""
    r, s = cfg.value or resid, cfg.error or sigma
    valid = F.col(r).isNotNull() & F.col(s).isNotNull() & (F.col(s) > 0)
    inside = F.coalesce(valid & (F.abs(F.col(r)) <= F.lit(cfg.sigmas) * F.col(s)), F.lit(False))
    out = df.withColumns({
        "outlier_gate_sigma": F.lit(float(cfg.sigmas)),
        "outlier_gate_resid_col": F.lit(r),
        "outlier_gate_sigma_col": F.lit(s),
        "outlier_gate_inlier": inside,
        "bad_hard": F.coalesce(valid & ~inside, F.lit(False)),
    })
    flags = [c for c in ("bad_ou", "bad_mad", "robust_outlier", "robust_global_outlier") if c in df.columns]
    return out.withColumns({c: F.col(c) & ~F.col("outlier_gate_inlier") for c in flags})
