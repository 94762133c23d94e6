"""Nearest-in-time matching of two tables by bounded nearest-neighbour intervals.

Every right record becomes an interval of left times for which it can be the
answer: its tolerance window, cut at the midpoints to neighbours that are valid
for every left channel value of the same cell.  Intervals are indexed by
(entity, channel cell, time bucket); left rows fall into exactly one entry of
that index, so one hash exchange per side serves the interval construction, the
range join and the final choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("_e", "_cell", "_bucket")
#: widening of floating-point comparisons that only pre-select; the exact ones follow in the join
SLACK = 1e-9
CELL_SLACK = 1e-6


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nearest_matches(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    entity: str,
    left_time: Column | str,
    right_time: Column | str,
    left_channel: Column | str,
    right_channel: Column | str,
    tolerance: float,
    channel_tolerance: float,
    bucket: float | None = None,
) -> DataFrame:
    """One row (left_id, right_id, distance) per left row that has a candidate.

    A candidate has the same entity, |channel difference| <= channel_tolerance
    and |time difference| <= tolerance (both inclusive).  The nearest in time
    wins; among equals the least right id.

    Defined cases: rows with a null entity or id, or a null, NaN or infinite
    time or channel never match; repeated left rows of one id, time and channel
    give one row; an empty side gives an empty result; further columns of
    either table are ignored, so clashing names do no harm.  Infinitely dense
    buckets stay correct, since intervals of equal records collapse to the
    record with the least id before the join.
    """
    if tolerance < 0 or channel_tolerance <= 0:
        raise ValueError("tolerance must be >= 0 and channel_tolerance > 0")
    width = float(bucket if bucket is not None else max(tolerance * 30, 1e-9))
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    lit = F.lit
    lo_cell = lambda c, d: F.floor((c + lit(d)) / lit(channel_tolerance))

    lhs = (
        left.select(
            F.col(left_id).alias("_l"), F.col(entity).alias("_e"),
            as_col(left_time).cast("double").alias("_lt"), as_col(left_channel).cast("double").alias("_lf"),
        )
        .where(F.col("_l").isNotNull() & F.col("_e").isNotNull() & _finite(F.col("_lt")) & _finite(F.col("_lf")))
        .withColumns({"_cell": lo_cell(F.col("_lf"), 0.0), "_bucket": F.floor(F.col("_lt") / lit(width))})
    )

    reach = tolerance + SLACK
    near = channel_tolerance * (1 + CELL_SLACK)
    rhs = (
        right.select(
            F.col(right_id).alias("_r"), F.col(entity).alias("_e"),
            as_col(right_time).cast("double").alias("_t"), as_col(right_channel).cast("double").alias("_f"),
        )
        .where(F.col("_r").isNotNull() & F.col("_e").isNotNull() & _finite(F.col("_t")) & _finite(F.col("_f")))
        .withColumn("_cell", F.explode(F.sequence(lo_cell(F.col("_f"), -near), lo_cell(F.col("_f"), near))))
        .withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_t") - lit(reach)) / lit(width)), F.floor((F.col("_t") + lit(reach)) / lit(width)))))
        .withColumn("_full", F.col("_cell") == lo_cell(F.col("_f"), 0.0))
    )

    # nearest records that are candidates for every left row of the cell
    over = f"OVER (PARTITION BY {', '.join(KEY)} ORDER BY _t, NOT _full, _r)"
    known = "CASE WHEN _full THEN _t END"
    spans = (
        rhs.withColumns({
            "_before": F.expr(f"lag({known}) IGNORE NULLS {over}"),
            "_after": F.expr(f"lead({known}) IGNORE NULLS {over}"),
        })
        .where(~(F.col("_full") & F.coalesce(F.col("_before") == F.col("_t"), lit(False))))
        .select(
            *KEY, "_r", "_t", "_f",
            F.greatest(F.col("_t") - lit(reach), F.when(F.col("_before") < F.col("_t"), (F.col("_before") + F.col("_t")) / 2 - lit(SLACK))).alias("_lo"),
            F.least(F.col("_t") + lit(reach), F.when(F.col("_after") > F.col("_t"), (F.col("_after") + F.col("_t")) / 2 + lit(SLACK))).alias("_hi"),
        )
    )

    distance = F.abs(F.col("_lt") - F.col("_t"))
    return (
        lhs.join(spans, list(KEY))
        .where(
            F.col("_lt").between(F.col("_lo"), F.col("_hi"))
            & (distance <= lit(tolerance))
            & (F.abs(F.col("_lf") - F.col("_f")) <= lit(channel_tolerance))
        )
        .groupBy(*KEY, "_l", "_lt", "_lf")
        .agg(F.min(F.struct(distance.alias("d"), F.col("_r").alias("r"))).alias("_m"))
        .select(F.col("_l").alias(left_id), F.col("_m.r").alias(right_id), F.col("_m.d").alias("distance"))
    )


def attach_nearest(left: DataFrame, right: DataFrame, *, prefix: str = "meta_", **how) -> DataFrame:
    """Left outer form: all left rows and columns plus the matched record's columns.

    Right columns get ``prefix`` wherever their name is taken on the left.
    Left rows without a candidate keep nulls there.
    """
    lid, rid = how["left_id"], how["right_id"]
    m = nearest_matches(left, right, **how).select(F.col(lid).alias("_m_l"), F.col(rid).alias("_m_r"))
    taken = {c.lower() for c in left.columns}
    named = [F.col(f"`{c}`").alias(f"{prefix}{c}" if c.lower() in taken else c) for c in right.columns]
    record = right.select(F.col(rid).alias("_k_r"), *named)
    found = m.join(record, F.col("_m_r") == F.col("_k_r")).drop("_m_r", "_k_r")
    return left.join(found, left[lid] == found["_m_l"], "left").drop("_m_l")
