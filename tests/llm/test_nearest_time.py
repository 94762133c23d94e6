import numpy as np
import pandas as pd
import pytest

from residua.llm.nearest_time import attach_nearest, nearest_matches

HOW = dict(left_id="l", right_id="r", entity="e", left_time="t", right_time="t", left_channel="f", right_channel="f", tolerance=0.5, channel_tolerance=1.0)
LEFT, RIGHT = "l long, e string, t double, f double", "r long, e string, t double, f double"


def brute(left, right, tol=0.5, ch=1.0):
    out = {}
    for a in left.itertuples():
        c = [(abs(a.t - b.t), b.r) for b in right.itertuples() if b.e == a.e and a.e is not None and abs(a.f - b.f) <= ch and abs(a.t - b.t) <= tol]
        if c:
            out[a.l] = min(c)[1]
    return out


def got(spark, left, right, **more):
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    return {x["l"]: x["r"] for x in nearest_matches(l, r, **(HOW | more)).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    step = 0.25 if seed % 2 else 1e-6  # coarse steps make many ties
    side = lambda k, name: pd.DataFrame({name: rng.permutation(k), "e": rng.choice(["a", "a", "a", "b"], k), "t": (rng.uniform(0, 20, k) / step).round() * step, "f": (rng.uniform(-3, 5, k) / step).round() * step})
    left, right = side(n, "l"), side(n, "r")
    want = brute(left, right)
    assert got(spark, left, right) == want
    assert got(spark, left, right, bucket=3.0) == want


def test_one_dense_entity(spark):
    rng = np.random.default_rng(9)
    left = pd.DataFrame({"l": range(200), "e": "a", "t": rng.uniform(0, 1, 200), "f": 5.0})
    right = pd.DataFrame({"r": range(400), "e": "a", "t": rng.uniform(0, 1, 400).round(1), "f": rng.choice([4.0, 5.0, 6.0, 6.5], 400)})
    assert got(spark, left, right) == brute(left, right)


def test_borders_nulls_and_wild_values(spark):
    inf, nan = float("inf"), float("nan")
    left = [(1, "a", 10.0, 5.0), (2, "a", 10.5, 6.0), (3, "a", None, 5.0), (4, "a", nan, 5.0), (5, "a", inf, 5.0), (6, None, 10.0, 5.0), (7, "a", 10.0, None), (8, "a", 1e300, 1e300), (9, "z", 10.0, 5.0), (1, "a", 10.0, 5.0)]
    right = [(20, "a", 10.0, 5.0), (10, "a", 10.0, 5.0), (30, "a", 9.0, 5.0), (40, "a", None, 5.0), (50, None, 10.0, 5.0), (60, "a", inf, 5.0), (70, "a", 1e300, 1e300)]
    assert got(spark, left, right) == {1: 10, 2: 10, 8: 70}
    assert got(spark, left, []) == {} and got(spark, [], right) == {}


def test_attach_keeps_rows_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", 10.0, 5.0, "x"), (2, "a", 99.0, 5.0, "y")], LEFT + ", name string")
    right = spark.createDataFrame([(7, "a", 10.1, 5.2, "rec")], RIGHT + ", name string")
    rows = {r["l"]: r for r in attach_nearest(left, right, **HOW).collect()}
    assert rows[1]["name"] == "x" and rows[1]["meta_name"] == "rec" and rows[1]["r"] == 7
    assert rows[2]["r"] is None and len(rows) == 2


def test_arguments(spark):
    with pytest.raises(ValueError, match="tolerance"):
        got(spark, [], [], tolerance=-1.0)
