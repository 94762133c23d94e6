"""Summaries and event tables of an annotated table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_summary(df: DataFrame, *, group: str = "grp", matched: str = "filename") -> DataFrame:
    """One row: n_rows, n_cols, n_unmatched, n_groups."""
    missing = F.count_if(F.col(matched).isNull()) if matched in df.columns else F.lit(0).cast("bigint")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"), missing.alias("n_unmatched"), F.count_distinct(group).alias("n_groups"))


def top_groups(df: DataFrame, *, group: str = "grp", rows: int = 20) -> DataFrame:
    """The groups with most rows."""
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(rows)


def backend_rates(df: DataFrame, keys: list[str], *, flags: tuple[str, ...] = ("bad_point", "event_member", "outlier_any")) -> DataFrame:
    """Per group the number of rows and the count and rate of each flag."""
    have = [f for f in flags if f in df.columns]
    cols = [F.count("*").alias("n")]
    for f in have:
        cols += [F.count_if(F.col(f)).alias(f"n_{f}"), F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"rate_{f}")]
    return df.groupBy(*keys).agg(*cols)


def event_table(df: DataFrame, keys: list[str], *, prefix: str = "transient", row_id: str = "toa_id") -> DataFrame:
    """One row per group and event: t0, amp, delta_chi2, members."""
    cols = [c for c in (f"{prefix}_t0", f"{prefix}_amp", f"{prefix}_delta_chi2") if c in df.columns]
    members = df.where(F.col(f"{prefix}_id") >= 0)
    return members.groupBy(*keys, f"{prefix}_id").agg(*[F.min_by(c, row_id).alias(c) for c in cols], F.count("*").alias("n_members"))


def structure_table(df: DataFrame, keys: list[str], features: tuple[str, ...], *, row_id: str = "toa_id") -> DataFrame:
    """One row per group and feature: chi2, dof, p, present."""
    out = None
    for f in features:
        cols = [c for c in ("chi2", "dof", "p", "present") if f"structure_{f}_{c}" in df.columns]
        if not cols:
            continue
        one = df.groupBy(*keys).agg(*[F.min_by(f"structure_{f}_{c}", row_id).alias(c) for c in cols]).withColumn("feature", F.lit(f))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no structure columns")
    return out.select(*keys, "feature", *[c for c in out.columns if c not in (*keys, "feature")])


def membership_quality(df: DataFrame, keys: list[str], *, prefix: str = "transient", sigma: str = "sigma", amp: str | None = None) -> DataFrame:
    """Per event the spread of |amp|/sigma of its members and whether most of them lie below 1."""
    z = F.abs(F.col(amp or f"{prefix}_amp")) / F.when(F.col(sigma) > 0, F.col(sigma))
    out = df.where(F.col(f"{prefix}_id") >= 0).groupBy(*keys, f"{prefix}_id").agg(
        F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.avg((z < 1).cast("double")).alias("frac_lt1"), F.avg((z < 2).cast("double")).alias("frac_lt2"), F.count("*").alias("n")
    )
    return out.withColumn("weak", F.col("frac_lt1") > 0.5)


def results_summary(df: DataFrame, keys: list[str], *, events: int = 30, groups: int = 20) -> dict[str, DataFrame]:
    """Totals, the strongest events and the rates of the largest groups."""
    flags = [c for c in ("bad_point", "event_member", "outlier_any", "bad", "bad_day") if c in df.columns]
    out = {"totals": df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in flags])}
    if "transient_id" in df.columns:
        out["events"] = event_table(df, keys).orderBy(F.desc("transient_delta_chi2")).limit(events)
    out["rates"] = backend_rates(df, keys).orderBy(F.desc("n"), *keys).limit(groups)
    return out
