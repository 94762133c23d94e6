"""Two-stage salted aggregation for keys that hold most records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.session import checkpointed


@dataclass(frozen=True)
class Partial:
    """An aggregate that can be merged: parts of a salt, how parts merge, the final value.

    ``parts`` maps a suffix to an aggregate of rows, ``merge`` the same suffix
    to an aggregate of such parts, ``final`` makes the result from the merged.
    """

    parts: dict
    merge: dict
    final: object

    @staticmethod
    def total(c: Column) -> Partial:
        return Partial({"s": F.sum(c)}, {"s": F.sum}, lambda p: p["s"])

    @staticmethod
    def count(where: Column | None = None) -> Partial:
        c = F.count("*") if where is None else F.count_if(where)
        return Partial({"n": c}, {"n": F.sum}, lambda p: F.coalesce(p["n"], F.lit(0)))

    @staticmethod
    def least(c: Column) -> Partial:
        return Partial({"m": F.min(c)}, {"m": F.min}, lambda p: p["m"])

    @staticmethod
    def most(c: Column) -> Partial:
        return Partial({"m": F.max(c)}, {"m": F.max}, lambda p: p["m"])

    @staticmethod
    def weighted_mean(value: Column, weight: Column) -> Partial:
        both = value.isNotNull() & weight.isNotNull()
        return Partial(
            {"vw": F.sum(F.when(both, value * weight)), "w": F.sum(F.when(both, weight))},
            {"vw": F.sum, "w": F.sum},
            lambda p: F.try_divide(p["vw"], p["w"]),
        )


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows; at most 1/share rows, whatever the input.

    The counts are written once, so that the rows are read once for them.
    """
    counts = checkpointed(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n").alias("_all"))  # a single row
    return counts.join(F.broadcast(total), F.col("_n") > F.col("_all") * F.lit(share)).select(*[F.col(k).alias(f"_h_{k}") for k in keys])


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: dict[str, Partial],
    *,
    identity: list[str],
    salts: int = 32,
    share: float = 0.01,
    hot_by: list[str] | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``df.groupBy(keys).agg(aggs)`` without a task per hot key.

    Rows of heavy keys get a salt from a hash of ``identity`` - random over
    rows, yet the same when a lost task runs again - and are aggregated by
    (key, salt); the parts are then merged by key.  Other keys have salt 0.

    ``hot_by`` names the part of the key whose values are weighed (default the
    whole key): where a few values of one part hold most rows, each of their
    keys is salted.  The heavy values are found by an exact count (or given as
    a one-row-per-value frame with columns ``_h_<key>``); there are at most
    1/share of them, which bounds the broadcast.  Null is a key of its own.  An
    empty table gives an empty result.  Columns of ``df`` that are in neither
    keys, aggregates nor identity are not read.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in identity]), F.lit(salts)).cast("int")
    part_of_key = hot_by or keys
    hot = heavy if heavy is not None else heavy_keys(df, part_of_key, share)
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in part_of_key])
    # 1/share rows at most, so this broadcast has a proven bound
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0)))
    first = [c.alias(f"_{name}_{part}") for name, p in aggs.items() for part, c in p.parts.items()]
    second = [p.merge[part](F.col(f"_{name}_{part}")).alias(f"_{name}_{part}") for name, p in aggs.items() for part in p.parts]
    merged = marked.groupBy(*keys, "_salt").agg(*first).groupBy(*keys).agg(*second)
    final = [p.final({part: F.col(f"_{name}_{part}") for part in p.parts}).alias(name) for name, p in aggs.items()]
    return merged.select(*keys, *final)
