"""Resolution of detector flags into bad points and event members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: flags that an event clears; ``bad``, ``bad_day`` and ``bad_dm_dvt`` stay
CLEARED = ("bad_ou", "bad_mad", "bad_hard", "robust_outlier", "robust_global_outlier", "bad_point")


class _Flags:
    """Columns that may be missing, read as false or as no event."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def flag(self, name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in self.names else F.lit(False)

    def event(self, name: str) -> Column:
        return F.coalesce(F.col(name) >= 0, F.lit(False)) if name in self.names else F.lit(False)

    def own_or_global(self, name: str, suffix: str) -> str:
        """Backend columns, or the global ones where these are missing."""
        return f"{name}_{suffix}" if f"{name}_{suffix}" in self.names else f"{name}_global_{suffix}"


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def outlier_flags(df: DataFrame) -> DataFrame:
    """Adds bad_ou and bad_mad, before the gate."""
    f = _Flags(df)
    return df.withColumns({"bad_ou": f.flag("bad"), "bad_mad": f.flag("robust_outlier") | f.flag("robust_global_outlier")})


def bad_points(df: DataFrame) -> DataFrame:
    """Adds bad_point, after the gate and the hard limit."""
    f = _Flags(df)
    return df.withColumn("bad_point", any_of([f.flag(c) for c in ("bad_ou", "bad_mad", "robust_outlier", "bad_hard", "bad_dm_dvt")]))


def clear_events(df: DataFrame) -> DataFrame:
    """Takes the outlier flags off all rows that any event claims."""
    f = _Flags(df)
    claims = [f.flag(f"{n}_member") for n in ("exp_dip", "solar_event", "eclipse_event", "gaussian_bump", "glitch")]
    claims += [f.event(c) for c in ("exp_dip_global_id", "gaussian_bump_id", "glitch_id", "transient_id", "transient_global_id")]
    for p in ("step", "step_global", "dm_step", "dm_step_global"):
        claims += [f.flag(f"{p}_informative"), f.flag(f"{p}_applicable"), f.event(f"{p}_id")]
    free = ~any_of(claims)
    return df.withColumns({c: f.flag(c) & free for c in CLEARED if c in f.names})


def event_flags(df: DataFrame) -> DataFrame:
    """Adds event_member and outlier_any; no row is both a bad point and an event member."""
    f = _Flags(df)
    events = [f.event(c) for c in ("transient_id", "transient_global_id", "exp_dip_global_id")]
    events += [f.flag(f.own_or_global(p, "informative")) for p in ("step", "dm_step")]
    events += [f.flag(f"{n}_member") for n in ("exp_dip", "solar_event", "eclipse_event", "gaussian_bump", "glitch")]
    out = df.withColumn("event_member", any_of(events) & ~f.flag("bad_point"))
    return out.withColumn("outlier_any", f.flag("bad_point") | F.col("event_member"))


def resolve(df: DataFrame) -> DataFrame:
    """All of the above in order, for a table whose gate and hard limit are done."""
    base = df if "bad_ou" in df.columns else outlier_flags(df)
    return event_flags(clear_events(bad_points(base)))


def membership_mask(df: DataFrame, *, use_applicable: bool = False) -> Column:
    """Rows that belong to an event, of steps the informative ones or all that are applicable."""
    f = _Flags(df)
    kind = "applicable" if use_applicable else "informative"
    return any_of([f.event("transient_id"), f.event("transient_global_id"), *[f.flag(f.own_or_global(p, kind)) for p in ("step", "dm_step")], f.flag("exp_dip_member"), f.flag("solar_event_member"), f.flag("eclipse_event_member"), f.flag("gaussian_bump_member"), f.flag("glitch_member")])
