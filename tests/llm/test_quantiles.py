import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residua.llm.quantiles import combine, compress, error_of, group_percentiles, merge, merge_within, nearest_rank, of_sorted, percentiles, query, summarise, tuples_for


def holds(s, data):
    """Every tuple's true ranks meet its interval."""
    data = np.sort(data)
    n, value, lo, hi = s
    assert n == len(data) and (np.diff(value) >= 0).all()
    left, right = np.searchsorted(data, value, "left") + 1, np.searchsorted(data, value, "right")
    assert (lo <= right).all() and (hi >= left).all() and (lo <= hi).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(-20, 20).map(float), max_size=60), min_size=1, max_size=6), st.integers(3, 12))
def test_merges_keep_true_rank_intervals(parts, keep):
    sums = [of_sorted(np.sort(np.array(p, float)), keep) for p in parts]
    whole = merge(sums, keep)
    data = np.concatenate([np.array(p, float) for p in parts])
    holds(whole, data)
    if len(data):
        assert whole[1][0] == data.min() and whole[1][-1] == data.max()
    holds(merge([merge(sums[:2], keep), *sums[2:]], keep), data)


def test_error_is_bounded():
    rng = np.random.default_rng(0)
    keep = tuples_for(0.01)
    level = [of_sorted(np.sort(rng.lognormal(size=5000)), keep) for _ in range(64)]
    data_n = 64 * 5000
    whole = merge_within([merge_within(level[i : i + 8], 0.01) for i in range(0, 64, 8)], 0.01)
    assert whole[0] == data_n and error_of(whole) <= 0.01
    assert len(compress(whole, 11)[1]) <= 11
    with pytest.raises(ValueError, match="eps"):
        tuples_for(0.7)


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)), "day": rng.integers(0, 30, n), "v": rng.normal(size=n).round(2)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def close(rows, pdf, eps):
    for r in rows:
        data = np.sort(pdf[pdf["k"] == r["k"]]["v"].to_numpy())
        assert r["n"] == len(data) and r["rank_error"] <= eps
        for q, c in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95")):
            rank = nearest_rank(len(data), q)
            off = max(np.searchsorted(data, r[c], "left") + 1 - rank, rank - np.searchsorted(data, r[c], "right"), 0)
            assert off <= r["rank_error"] * len(data)


def test_groups_against_exact_ranks(table):
    df, pdf = table
    rows = group_percentiles(df, ["k"], "v", eps=0.01).collect()
    assert len(rows) == 3
    close(rows, pdf, 0.01)
    small_buffers = percentiles(summarise(df, ["k"], "v", eps=0.01, rows_held=100), ["k"]).collect()
    close(small_buffers, pdf, 0.01)


def test_days_combine_into_the_whole(table):
    df, pdf = table
    days = summarise(df, ["k", "day"], "v", eps=0.01)
    close(percentiles(combine(days, ["k"], eps=0.01), ["k"]).collect(), pdf, 0.01)


def test_nulls_nan_and_no_rows(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", float("nan")), ("a", float("inf")), ("a", None), ("b", 2.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit(1)).withColumn("value", F.lit("x"))
    got = {r["k"]: (r["n"], r["p50"]) for r in group_percentiles(df, ["k"], "v").collect()}
    assert got[None][0] == 2 and got["b"] == (2, 2.0) and "a" not in got
    assert group_percentiles(df.where("false"), ["k"], "v").count() == 0


def test_query_of_one_value():
    assert query(of_sorted(np.array([4.0]), 5), 0.5) == (4.0, 1, 1)


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 2**31), st.sampled_from([2, 3, 9]), st.sampled_from([0.02, 0.1]))
def test_any_depth_of_merging_stays_within_eps(seed, fan, eps):
    """Every rank is met within the error that the summary states, and that is within eps after many levels."""
    rng = np.random.default_rng(seed)
    data = [np.sort(rng.choice([rng.normal(size=200), rng.integers(0, 9, 200).astype(float)])) for _ in range(fan**4 if fan == 2 else 27)]
    sums = [of_sorted(x, tuples_for(eps)) for x in data]
    while len(sums) > 1:
        sums = [merge_within(sums[i : i + fan], eps) for i in range(0, len(sums), fan)]
    (whole,) = sums
    every = np.sort(np.concatenate(data))
    holds(whole, every)
    error = error_of(whole)
    assert error <= eps and len(whole[1]) < len(every)
    for q in np.linspace(0, 1, 41):
        v, _, _ = query(whole, q)
        rank = nearest_rank(len(every), q)
        off = max(np.searchsorted(every, v, "left") + 1 - rank, rank - np.searchsorted(every, v, "right"), 0)
        assert off <= error * len(every)


def test_exact_summaries_have_no_error(spark):
    assert error_of(of_sorted(np.array([1.0, 2.0]), 9)) == 0.0
    row = group_percentiles(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), ["k"], "v").first()
    assert row["rank_error"] == 0.0 and (row["p5"], row["p50"], row["p95"]) == (1.0, 3.0, 3.0)
