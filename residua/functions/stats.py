"""Statistics as column expressions, with SQL text where another engine needs the same formula."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: Chebyshev coefficients of erfc (Press et al., relative error below 1.2e-7), constant term last
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
MAD_TO_SIGMA = 1.4826


def erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0 as SQL text that Spark and other engines read alike."""
    t = f"(1e0/(1e0+0.5e0*({x})))"
    poly = f"({ERFC[0]}e0)"
    for c in ERFC[1:]:
        poly = f"({c}e0+{t}*{poly})"
    return f"({t}*exp(-({x})*({x})+{poly}))"


def erfc(x: Column) -> Column:
    """erfc of a non-negative column."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[0])
    for c in ERFC[1:]:
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal."""
    return erfc(F.abs(z) / F.lit(2.0**0.5))


def normal_upper(z: Column) -> Column:
    """P(Z > z)."""
    half = erfc(F.abs(z) / F.lit(2.0**0.5)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def chi2_tail(chi2: Column, dof: Column) -> Column:
    """Upper tail of chi-square by the Wilson-Hilferty cube root; null for dof <= 0, 1 for negative chi2."""
    k = F.nullif(dof.cast("double"), F.lit(0.0))
    h = F.lit(2.0) / (F.lit(9.0) * k)
    z = (F.cbrt(chi2 / k) - (1 - h)) / F.sqrt(h)
    return F.when(dof > 0, F.when(chi2 < 0, F.lit(1.0)).otherwise(normal_upper(z)))


def fdr_flags(df: DataFrame, keys: list[str], p: str, q: float, flag: str) -> DataFrame:
    """Benjamini-Hochberg: rows whose p is at most the largest p_(k) <= q k/m of their group."""
    over = Window.partitionBy(*keys)
    rank = F.row_number().over(over.orderBy(F.col(p).asc_nulls_last()))
    m = F.count(p).over(over)
    passing = df.withColumn("_ok", F.when(F.col(p) <= F.lit(q) * rank / m, F.col(p)))
    limit = F.max("_ok").over(over)
    return passing.withColumn(flag, F.coalesce(F.col(p) <= limit, F.lit(False))).drop("_ok")


def golden_max(f: Callable[[float], float], low: float, high: float, tol: float, rounds: int) -> tuple[float, float]:
    """Argument and value of a maximum by golden-section search on [low, high]."""
    ratio = (5.0**0.5 - 1.0) / 2.0
    x1, x2 = high - ratio * (high - low), low + ratio * (high - low)
    y1, y2 = f(x1), f(x2)
    while rounds > 0 and abs(high - low) > tol:
        rounds -= 1
        if y1 > y2:
            high, x2, y2 = x2, x1, y1
            x1 = high - ratio * (high - low)
            y1 = f(x1)
        else:
            low, x1, y1 = x1, x2, y2
            x2 = low + ratio * (high - low)
            y2 = f(x2)
    return (x1, y1) if y1 >= y2 else (x2, y2)


def mjd_of(ts: Column) -> Column:
    """Modified Julian Date of a timestamp (session time zone UTC)."""
    return F.lit(40587.0) + F.unix_micros(ts.cast("timestamp")) / F.lit(8.64e10)


def year_of_mjd(mjd: Column) -> Column:
    return (F.lit(2000.0) + (mjd - F.lit(51544.5)) / F.lit(365.25)).cast("int")


def folded_distance(phase: Column, centre: float) -> Column:
    d = F.abs(phase - F.lit(centre))
    return F.least(d, F.lit(1.0) - d)
