"""Nearest as-of join on one time column, with tolerance and optional equality keys.

Both sides are put into one ordered stream per (keys, time block); the nearest
record before and after each left row are carried along by window functions.
Right rows near a block's edge go to the neighbouring block as well, so blocks
are independent and no key is bound to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.operators.blocks import small
from residua.session import checkpointed


def nearest_asof(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_on: Column | str, right_on: Column | str, tolerance: float, by: dict[str, tuple[Column, Column]] | None = None, block: float = 1.0, few: bool = False) -> DataFrame:
    """(left_id, right_id) of left rows with a right row within ``tolerance`` (inclusive).

    At equal distance the earlier record wins; among records of one time the
    greatest right id counts looking back, the least looking ahead.  ``by`` maps
    a name to the left and right expressions that must be equal.  Rows with a
    null time or key never match; an empty side gives an empty result.  With
    ``few`` left rows, the right ones in blocks without any are left out before
    they are sorted.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    by = by or {}
    names = [f"_by_{n}" for n in by]
    width = max(block, 4 * tolerance)
    lhs = left.select(F.col(left_id).alias("_l"), col(left_on).cast("double").alias("_k"), *[v[0].alias(n) for n, v in zip(names, by.values())])
    rhs = right.select(F.col(right_id).alias("_r"), col(right_on).cast("double").alias("_k"), *[v[1].alias(n) for n, v in zip(names, by.values())])
    usable = F.col("_k").isNotNull() & ~F.isnan("_k")
    for n in names:
        usable = usable & F.col(n).isNotNull()
    at = lambda d: F.floor((F.col("_k") + F.lit(d)) / F.lit(width))
    lhs = lhs.where(usable).select(*names, at(0.0).alias("_b"), "_k", "_l", F.lit(None).cast(right.schema[right_id].dataType).alias("_r"), F.lit(1).alias("_side"))
    rhs = rhs.where(usable).withColumn("_b", F.explode(F.array_distinct(F.array(at(-2 * tolerance), at(0.0), at(2 * tolerance)))))
    if few:
        rhs = rhs.join(small(lhs.select(*names, "_b").distinct()), [*names, "_b"], "left_semi")
    rhs = rhs.select(*names, "_b", "_k", F.lit(None).cast(left.schema[left_id].dataType).alias("_l"), "_r", F.lit(0).alias("_side"))
    both = lhs.unionByName(rhs)
    part = Window.partitionBy(*names, "_b")
    seen = F.when(F.col("_side") == 0, F.struct("_k", "_r"))
    back = F.last(seen, True).over(part.orderBy("_k", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last(seen, True).over(part.orderBy(F.desc("_k"), "_side", F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_side = 1")
    before = F.when(F.col("_k") - F.col("_back._k") <= tolerance, F.col("_k") - F.col("_back._k"))
    after = F.when(F.col("_ahead._k") - F.col("_k") <= tolerance, F.col("_ahead._k") - F.col("_k"))
    pick = F.when(before.isNotNull() & (after.isNull() | (before <= after)), F.col("_back._r")).when(after.isNotNull(), F.col("_ahead._r"))
    return got.select(F.col("_l").alias(left_id), pick.alias(right_id)).where(F.col(right_id).isNotNull())


def auto_tolerance(cfg: Options, max_offset_sec: float) -> float:
    """The tolerance widened to twice the largest TIME offset."""
    return max(cfg.tolerance_days, 2.0 * abs(max_offset_sec) / 86400.0)


def merge_time_and_meta(toas: DataFrame, meta: DataFrame, cfg: Options = options("merge"), *, toa_id: str = "toa_id", meta_id: str = "meta_id", entity: str | None = "psr") -> DataFrame:
    """TOAs with the columns of their record: by corrected time, then per frequency bin, then by plain mjd.

    Each stage looks at the rows the one before left without a record.  Right
    columns whose name is taken get the suffix _meta; rows without a record
    keep nulls.  ``cfg.by_channel`` asks for equal frequency bins in the first
    stage, too.  Without ``cfg.channel_mhz`` frequencies are not looked at, and
    the second stage falls away.  The matches of a stage and the rows that it
    leaves are written, so that the next does not compute them again.
    """
    keys = {"entity": (F.col(entity), F.col(entity))} if entity else {}
    corrected = F.coalesce("sat_corr", "mjd")
    stages = [(corrected, keys), (F.col("mjd"), keys)]
    if cfg.channel_mhz is not None:
        channel = F.rint(F.col("freq") / cfg.channel_mhz)
        binned = {**keys, "bin": (channel, channel)}
        stages = [(corrected, binned if cfg.by_channel else keys), (corrected, binned), (F.col("mjd"), keys)]
    read = dict.fromkeys([toa_id, *[entity] * bool(entity), "mjd", *["freq"] * (cfg.channel_mhz is not None)])
    rest, found = toas.select(*read), None
    for k, (right_on, by) in enumerate(stages):
        m = checkpointed(nearest_asof(rest, meta, left_id=toa_id, right_id=meta_id, left_on="mjd", right_on=right_on, tolerance=cfg.tolerance_days, by=by, few=k > 0))
        found = m if found is None else found.unionByName(m)
        if k + 1 < len(stages):
            rest = checkpointed(rest.join(m.select(toa_id), toa_id, "left_anti"))
    taken = {c.lower() for c in toas.columns}
    record = meta.select(F.col(meta_id).alias("_m"), *[F.col(f"`{c}`").alias(f"{c}_meta" if c.lower() in taken else c) for c in meta.columns])
    pairs = found.select(F.col(toa_id).alias("_t"), F.col(meta_id).alias("_m")).join(record, "_m").drop("_m")
    return toas.join(pairs, toas[toa_id] == pairs["_t"], "left").drop("_t")


def unmatched_sample(merged: DataFrame, *, column: str = "filename", rows: int = 5) -> DataFrame:
    """A few rows without a record, for an error message: their ids, times, frequencies, values and sigmas."""
    shown = [c for c in ("toa_id", "psr", "mjd", "freq", "resid", "sigma") if c in merged.columns]
    return merged.where(F.col(column).isNull()).select(*shown).limit(rows)
