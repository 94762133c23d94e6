"""Running sums and previous rows of long series without one task per series.

A window over a whole series puts it into one task.  Here the window covers
(series, time block) only; what earlier blocks contribute comes from a table of
one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.session import stored

BLOCK_DAYS = 32.0
#: stored bytes of a side that is broadcast, and rows of a group whose median is taken by the built-in aggregate
SMALL, DIRECT_ROWS = 4_000_000, 2_000_000


def in_blocks(df: DataFrame, time: str, days: float = BLOCK_DAYS) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(time) / F.lit(days)))


def running_sums(df: DataFrame, keys: list[str], time: str, row_id: str, sums: dict[str, Column], *, days: float = BLOCK_DAYS) -> DataFrame:
    """Adds ``<name>`` (sum up to and with the row) and ``<name>_all`` (of the series) for each of ``sums``.

    Rows are ordered by (time, row_id).  Keys and time must not be null.
    """
    rows = in_blocks(df, time, days)
    per = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    series = Window.partitionBy(*keys)
    before = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(series).alias(f"{n}_all") for n in sums],
    )
    local = Window.partitionBy(*keys, "_block").orderBy(time, row_id).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in sums.items()}).join(per, [*keys, "_block"])
    out = out.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_block", *[f"_{a}_{n}" for a in "lb" for n in sums])


def previous_rows(df: DataFrame, keys: list[str], time: str, row_id: str, cols: list[str], *, days: float = BLOCK_DAYS) -> DataFrame:
    """Adds ``prev_<col>`` of the row before in (time, row_id) order of its series; null on the first."""
    rows = in_blocks(df, time, days)
    order = F.struct(F.col(time), F.col(row_id))
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(*cols), order).alias("_last"))
    last = last.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    local = Window.partitionBy(*keys, "_block").orderBy(time, row_id)
    out = rows.withColumn("_prev", F.lag(F.struct(*cols)).over(local)).join(last, [*keys, "_block"])
    got = F.coalesce("_prev", "_carry")
    return out.withColumns({f"prev_{c}": got[c] for c in cols}).drop("_prev", "_carry", "_block")


def small(df: DataFrame, *, most: int = SMALL) -> DataFrame:
    """``df`` written to the shared folder, marked for broadcast only if the files take at most ``most`` bytes."""
    kept, size = stored(df)
    return F.broadcast(kept) if size <= most else kept


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, *, direct_rows: int = DIRECT_ROWS, largest: int | None = None) -> DataFrame:
    """keys and the exact median (mean of the middle two) of the non-null values.

    The built-in aggregate keeps all distinct values of a group in one task, so
    it is used only while the largest group is at most ``direct_rows``.  Beyond
    that a mergeable sketch brackets the middle ranks, and only the rows in the
    bracket, about one in 500, are ranked exactly.  ``largest`` is a bound on
    the rows of a group where it is known; else they are counted.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if (largest_group(known, keys) if largest is None else largest) <= direct_rows:
        return known.groupBy(*keys).agg(F.median("_v").alias(name))
    share = 1 / 1000
    near = small(
        known.groupBy(*keys)
        .agg(F.percentile_approx("_v", [0.5 - share, 0.5 + share], 4000).alias("_q"), F.count("*").alias("_n"))
        .select(*keys, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), "_n")
    )
    at = known.join(near, keys)
    below = at.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    ranked = (
        at.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
        .join(below, keys)
        .withColumns({"_to": F.col("_below") + F.col("_upto"), "_from": F.col("_below") + F.col("_upto") - F.col("_c")})
    )
    hit = lambda k: F.max(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v")))
    half = F.floor((F.col("_n") - 1) / 2)
    return ranked.groupBy(*keys).agg(((hit(half) + hit(F.floor(F.col("_n") / 2))) / 2).alias(name))


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, str], *, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """keys and ``exact_median`` of several columns, by name, in one pass where the largest group permits."""
    sizes = df.groupBy(*keys).agg(*[F.count(v).alias(n) for n, v in values.items()])
    largest = sizes.agg(*[F.max(n).alias(n) for n in values]).first()
    most = {n: largest[n] or 0 for n in values}
    if max(most.values()) <= direct_rows:
        return df.groupBy(*keys).agg(*[F.median(v).alias(n) for n, v in values.items()])
    out = None
    for n, v in values.items():
        one = exact_median(df, keys, v, n, direct_rows=direct_rows, largest=most[n])
        out = one if out is None else out.join(one, keys, "full")
    return out


def ranked(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with the place (from 1) of each row in the order of columns, and the number of rows.

    Rows are dealt out by ranges of the order and written, so that the ranges
    stay as they are; the counts of the ranges, one small row each, give the
    place at which each range begins.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * 4
    rows = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))[0]
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())  # one row per range
    begins, total = {}, 0
    for part, n in counts:
        begins[part] = total
        total += n
    if not begins:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_part"), 0
    begin = F.create_map(*[F.lit(x) for kv in begins.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + begin[F.col("_part")]
    return rows.withColumn(name, place.cast("long")).drop("_part"), total
