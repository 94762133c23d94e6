"""Percentiles with bounded rank error from mergeable summaries.

A summary is a rising list of values, each with the least and the greatest rank
it can have among the n values seen (a rank interval).  Summaries of parts are
merged by adding rank bounds, which keeps their error as a share of the rows.
Then tuples are left out as long as the rank intervals of their neighbours stay
within the permitted uncertainty: the error that the summary has, plus a part
of what is left up to ``eps``.  So the error is known from the intervals, and
never exceeds ``eps``, however often summaries are merged; more merges only
keep more tuples.  Nothing is random: the same rows in the same parts give the
same summary, and any parts combine into the whole.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: summaries that are merged before one compression
FAN_IN = 64
#: share of the error still left that one compression may use up
STEP = 0.25

SUMMARY = [
    T.StructField("n", T.LongType(), False),
    T.StructField("value", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("rank_min", T.ArrayType(T.LongType(), False), False),
    T.StructField("rank_max", T.ArrayType(T.LongType(), False), False),
]
_ARROW = {"n": pa.int64(), "value": pa.list_(pa.float64()), "rank_min": pa.list_(pa.int64()), "rank_max": pa.list_(pa.int64())}

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def tuples_for(eps: float) -> int:
    """Tuples that the summary of any number of sorted values takes after its first compression."""
    if not 0 < eps < 0.5:
        raise ValueError("eps must be between 0 and 0.5")
    return math.ceil(1 / (2 * STEP * eps)) + 1


def of_sorted(x: np.ndarray, keep: int) -> Summary:
    """Summary of sorted values; exact where there are at most ``keep``."""
    n = len(x)
    at = np.arange(n) if n <= keep else np.unique(np.rint(np.linspace(0, n - 1, keep)).astype(np.int64))
    rank = at + 1
    return n, x[at], rank, rank


def merged(parts: list[Summary]) -> Summary:
    """Summary of all values of the parts, with every tuple of theirs."""
    parts = [p for p in parts if p[0]]
    if not parts:
        return 0, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    value = np.concatenate([p[1] for p in parts])
    # what passing a tuple adds to the bounds of all later ones
    low = np.concatenate([np.diff(p[2], prepend=0) for p in parts])
    high = np.concatenate([np.diff(p[3], append=p[0] + 1) for p in parts])
    order = np.argsort(value, kind="stable")
    low, high = low[order], high[order]
    start = sum(int(p[3][0]) - 1 for p in parts)
    rank_min = np.cumsum(low)
    rank_max = start + np.cumsum(high) - high + 1
    return sum(p[0] for p in parts), value[order], rank_min, rank_max


def merge(parts: list[Summary], keep: int) -> Summary:
    """``merged``, compressed to ``keep`` tuples."""
    return compress(merged(parts), keep)


def merge_within(parts: list[Summary], eps: float) -> Summary:
    """``merged``, compressed by the uncertainty that ``eps`` permits."""
    return compress_within(merged(parts), eps)


def compress_within(s: Summary, eps: float) -> Summary:
    """As few tuples as the permitted uncertainty allows; the ends stay.

    From each tuple kept the next is the farthest whose greatest rank is within
    twice the permitted error of the least rank of the former, so that any rank
    between is met within the permitted error.
    """
    n, value, lo, hi = s
    if len(value) <= tuples_for(eps):
        return s
    error = error_of(s)
    allowed = 2 * n * (error + STEP * max(0.0, eps - error))
    low, high = lo.tolist(), hi.tolist()
    at, last = [0], len(low) - 1
    while at[-1] < last:
        i = at[-1]
        at.append(max(i + 1, bisect_right(high, low[i] + allowed, i + 1) - 1))
    at = np.array(at)
    return n, value[at], lo[at], hi[at]


def compress(s: Summary, keep: int) -> Summary:
    """At most ``keep`` tuples, nearest to evenly spaced ranks; the ends stay."""
    n, value, lo, hi = s
    if len(value) <= keep:
        return s
    want = np.linspace(1, n, keep)
    mid = (lo + hi) / 2
    at = np.searchsorted(mid, want).clip(0, len(mid) - 1)
    before = (at - 1).clip(0)
    at = np.where(np.abs(mid[before] - want) < np.abs(mid[at] - want), before, at)
    at[0], at[-1] = 0, len(mid) - 1
    at = np.unique(at)
    return n, value[at], lo[at], hi[at]


def nearest_rank(n: int, q: float) -> int:
    """The rank from 1 to n that quantile q asks for."""
    return 1 + math.floor(q * (n - 1) + 0.5)


def query(s: Summary, q: float) -> tuple[float, int, int]:
    """Value at quantile q (of the nearest rank) with the bounds of its rank."""
    n, value, lo, hi = s
    rank = nearest_rank(n, q)
    i = int(np.argmin(np.maximum(rank - lo, hi - rank)))
    return float(value[i]), int(lo[i]), int(hi[i])


def error_of(s: Summary) -> float:
    """Largest rank error of any quantile of this summary, as a share of n; 0 while every value is kept."""
    n, _, lo, hi = s
    if n <= 1:
        return 0.0
    # with e half the widest reach from a tuple's least rank to the next one's greatest: of the tuples whose greatest rank
    # is at most r + e the last has a least rank of at least r - e
    return int((hi[1:] - lo[:-1]).max()) // 2 / n if len(lo) > 1 else 0.0


def _batch(keys: list[list], rows: list[Summary], key_types: list, names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(k, t) for k, t in zip(keys, key_types)]
    cols += [pa.array([s[i] for s in rows], t) for i, t in enumerate(_ARROW.values())]
    return pa.RecordBatch.from_arrays(cols, names=[*names, *_ARROW])


def summarise(df: DataFrame, keys: list[str], value: str, *, eps: float = 0.005, rows_held: int = 1_000_000, merged: bool = True) -> DataFrame:
    """One summary row (keys, n, value, rank_min, rank_max) per key.

    Each partition makes summaries of its own rows, without a shuffle; they are
    merged in two steps, first FAN_IN salts of partitions, then keys.  A key may
    hold any share of the rows: what moves is at most ``tuples_for(eps)`` tuples
    for each key and partition, and no more than the rows themselves.

    Defined cases: nulls, NaN and infinities are left out; a key without any
    finite value has no row; null is a key of its own; ties and repeated rows
    count each; an empty table gives an empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keep = tuples_for(eps)
    names = [f"_k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    src = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], v.alias("_v")
    )
    key_fields = [T.StructField(n, src.schema[n].dataType) for n in names]
    arrow = [to_arrow_type(f.dataType) for f in key_fields]
    schema = T.StructType([*key_fields, T.StructField("_salt", T.IntegerType()), *SUMMARY])
    salt_of = lambda part: part % FAN_IN

    def flush(held: list[pa.RecordBatch], part: int):
        t = pa.Table.from_batches(held)
        x = t.column("_v").to_numpy()
        if names:
            code = np.zeros(t.num_rows, np.int64)
            for n in names:
                c = t.column(n).combine_chunks().dictionary_encode(null_encoding="encode")
                c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
                code = code * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False)
        else:
            code = np.zeros(t.num_rows, np.int64)
        order = np.lexsort((x, code))
        x, code = x[order], code[order]
        cut = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        bounds = np.r_[cut, len(code)]
        rows = [of_sorted(x[a:b], keep) for a, b in zip(bounds[:-1], bounds[1:])]
        firsts = pa.array(order[cut])
        kcols = [t.column(n).take(firsts).combine_chunks() for n in names]
        kcols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kcols]
        cols = [*kcols, pa.array([part] * len(rows), pa.int32())]
        cols += [pa.array([s[i] for s in rows], ty) for i, ty in enumerate(_ARROW.values())]
        return pa.RecordBatch.from_arrays(cols, names=[*names, "_salt", *_ARROW])

    def local(batches):
        from pyspark import TaskContext

        part = salt_of(TaskContext.get().partitionId())
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= rows_held:
                yield flush(held, part)
                held, n = [], 0
        if held:
            yield flush(held, part)

    out = src.mapInArrow(local, schema)
    if merged:
        out = _merge_sorted(out, [*names, "_salt"], [*arrow, pa.int32()], eps)
        out = _merge_sorted(out.drop("_salt"), names, arrow, eps)
    else:
        out = out.drop("_salt")
    for k, n in zip(keys, names):
        out = out.withColumnRenamed(n, k)
    return out


def _merge_sorted(parts: DataFrame, names: list[str], arrow: list, eps: float) -> DataFrame:
    """Merges the summaries of equal keys, streaming sorted rows and holding FAN_IN of one key."""
    schema = parts.schema
    spread = parts.repartition(*names).sortWithinPartitions(*names) if names else parts.coalesce(1)

    def run(batches):
        key, levels = None, []

        def add(s):
            # a tree of fan-in FAN_IN: a compression for each level only
            level = 0
            while True:
                if len(levels) <= level:
                    levels.append([])
                levels[level].append(s)
                if len(levels[level]) < FAN_IN:
                    return
                s, levels[level] = merge_within(levels[level], eps), []
                level += 1

        def done(k):
            s = merge_within([x for level in levels for x in level], eps)
            return _batch([[x] for x in k], [s], arrow, names)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(names))]
            n, v, lo, hi = (b.column(b.schema.get_field_index(c)) for c in _ARROW)
            for i in range(b.num_rows):
                k = tuple(c[i] for c in cols)
                if key is None or k != key:
                    if key is not None:
                        yield done(key)
                    key, levels = k, []
                add((n[i].as_py(), v[i].values.to_numpy(), lo[i].values.to_numpy(), hi[i].values.to_numpy()))
        if key is not None:
            yield done(key)

    return spread.mapInArrow(run, T.StructType([*[schema[n] for n in names], *SUMMARY]))


def combine(summaries: DataFrame, keys: list[str], *, eps: float = 0.005) -> DataFrame:
    """Merges summaries of separate days, loads or tables into one per key.

    ``summaries`` holds rows of ``summarise`` with any further columns, which
    are ignored.  Combining any number of times keeps the error within ``eps``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    src = summaries.select(*keys, *_ARROW)
    arrow = [to_arrow_type(src.schema[k].dataType) for k in keys]
    return _merge_sorted(src, keys, arrow, eps)


def percentiles(summaries: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Keys, n, one column p<percent> per quantile, rank_error (bound, share of n).

    A percentile is the value of the nearest rank 1 + floor(q (n - 1) + 1/2); the
    value given has a rank within rank_error * n of it, and is exact at 0.
    """
    names = [f"p{q * 100:g}".replace(".", "_") for q in quantiles]
    fields = ", ".join([*[f"{n} double" for n in names], "rank_error double"])

    @F.pandas_udf(f"struct<{fields.replace(' double', ':double')}>")
    def read(n: pd.Series, value: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
        rows = []
        for s in zip(n, value, lo, hi):
            s = (int(s[0]), np.asarray(s[1]), np.asarray(s[2]), np.asarray(s[3]))
            rows.append([*[query(s, q)[0] for q in quantiles], error_of(s)])
        return pd.DataFrame(rows, columns=[*names, "rank_error"])

    got = summaries.select(*keys, "n", read("n", "value", "rank_min", "rank_max").alias("_p"))
    return got.select(*keys, "n", *[F.col(f"_p.{n}").alias(n) for n in names], F.col("_p.rank_error").alias("rank_error"))


def group_percentiles(df: DataFrame, keys: list[str], value: str, *, eps: float = 0.005, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """``percentiles`` of ``summarise``."""
    return percentiles(summarise(df, keys, value, eps=eps), keys, quantiles)
