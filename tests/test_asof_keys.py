import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.options import options
from residua.operators.asof import auto_tolerance, merge_time_and_meta, nearest_asof, unmatched_sample
from residua.operators.blocks import exact_medians
from residua.operators.keys import ensure_sys_group, file_triplet


def brute(left, right, tol, by=()):
    out = {}
    for a in left.itertuples():
        same = [b for b in right.itertuples() if all(getattr(a, k) == getattr(b, k) for k in by)]
        back = [(b.k, b.r) for b in same if b.k <= a.k and a.k - b.k <= tol]
        ahead = [(b.k, b.r) for b in same if b.k >= a.k and b.k - a.k <= tol]
        b, f = max(back, default=None), min(ahead, default=None)
        if b and (f is None or a.k - b[0] <= f[0] - a.k):
            out[a.l] = b[1]
        elif f:
            out[a.l] = f[1]
    return out


@pytest.mark.parametrize(("tol", "block"), [(0.3, 1.0), (0.3, 50.0), (0.0, 1.0)])
def test_against_brute_force(spark, tol, block):
    rng = np.random.default_rng(4)
    left = pd.DataFrame({"l": range(200), "k": rng.uniform(0, 12, 200).round(1), "g": rng.choice(["x", "y"], 200)})
    right = pd.DataFrame({"r": range(150), "k": rng.uniform(0, 12, 150).round(1), "g": rng.choice(["x", "y"], 150)})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    how = dict(left_id="l", right_id="r", left_on="k", right_on="k", tolerance=tol, block=block)
    # rounding of differences can tip exact ties, so times are compared as whole tenths
    a, b = a.withColumn("k", F.round(F.col("k") * 10)), b.withColumn("k", F.round(F.col("k") * 10))
    how["tolerance"] = tol * 10
    left["k"], right["k"] = (left["k"] * 10).round(), (right["k"] * 10).round()
    assert {r["l"]: r["r"] for r in nearest_asof(a, b, **how).collect()} == brute(left, right, tol * 10)
    by = {"g": (F.col("g"), F.col("g"))}
    assert {r["l"]: r["r"] for r in nearest_asof(a, b, by=by, **how).collect()} == brute(left, right, tol * 10, ("g",))
    assert nearest_asof(a.where("false"), b, **how).count() == 0 and nearest_asof(a, b.where("false"), **how).count() == 0


def test_few_left_rows_leave_records_of_other_blocks_out(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"l": range(6), "k": [3.0, 3.0, 9.0, 10.0, 250.0, 999.0], "g": list("xyxyxy")})
    right = pd.DataFrame({"r": range(1200), "k": rng.integers(0, 1000, 1200).astype(float), "g": rng.choice(["x", "y"], 1200)})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    how = dict(left_id="l", right_id="r", left_on="k", right_on="k", tolerance=2.0, block=10.0)
    for by in ({}, {"g": (F.col("g"), F.col("g"))}):
        got = {r["l"]: r["r"] for r in nearest_asof(a, b, by=by, few=True, **how).collect()}
        assert got == {r["l"]: r["r"] for r in nearest_asof(a, b, by=by, **how).collect()} == brute(left, right, 2.0, tuple(by))
    assert nearest_asof(a.where("false"), b, few=True, **how).count() == 0
    plan = nearest_asof(a, b, few=True, **how)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and plan.index("Window") < plan.index("Join LeftSemi")  # before they are sorted


def test_merge_falls_back_to_plain_time(spark):
    toas = spark.createDataFrame([(i, "p", 100.0 + i, 1400.0 + i, 1.0) for i in range(3)] + [(9, "p", 500.0, 1400.0, 1.0)], "toa_id long, psr string, mjd double, freq double, resid double")
    meta = spark.createDataFrame([(10 + i, "p", 100.0 + i, 200.0 if i == 2 else 100.0 + i, 1400.0 + i, f"f{i}", "t") for i in range(3)], "meta_id long, psr string, mjd double, sat_corr double, freq double, filename string, _timfile string")
    for by_freq in (False, True):
        out = {r["toa_id"]: r for r in merge_time_and_meta(toas, meta, options("merge", by_channel=by_freq)).collect()}
        assert [out[i]["filename"] for i in range(3)] == ["f0", "f1", "f2"] and out[9]["filename"] is None
        assert out[1]["freq_meta"] == 1401.0
    lost = unmatched_sample(merge_time_and_meta(toas, meta)).collect()
    assert [r["toa_id"] for r in lost] == [9]
    assert auto_tolerance(options("merge"), 10.0) == 20.0 / 86400 and auto_tolerance(options("merge"), 0.1) == 2.0 / 86400


@pytest.mark.parametrize(
    ("path", "want"),
    [("x/EFF.PX.1400.tim", ("EFF", "PX", 1400.0)), ("eff.1400.tim", ("EFF", None, 1400.0)), ("nrt.PX.tim", ("NRT", "PX", None)), ("J1_all.tim", (None, None, None)), ("FOO.PX.tim", (None, None, None)), ("LEAP.tim", ("LEAP", None, None)), ("SRT.PX.band.tim", ("SRT", "PX", None))],
)
def test_triplet(spark, path, want):
    r = spark.range(1).select(file_triplet(F.lit(path)).alias("t")).first()["t"]
    assert (r["tel"], r["backend"], r["band"]) == want


def test_sys_group(spark):
    schema = "row long, _timfile string, filename string, freq double, cenfreq double, be string, sys string, grp string"
    rows = [
        (1, "d/EFF.PX.1400.tim", "a.ar", 1380.5, None, None, None, None),
        (2, "d/EFF.PX.1400.tim", "a.ar", 1381.5, 1410.5, None, "UNK.UNK.UNK", "unknown"),
        (3, "d/x_all.tim", "a.ar", 800.0, None, "px", None, None),
        (4, "d/x_all.tim", "JBO.tim", 802.0, None, None, None, None),
        (5, "d/x_all.tim", "a.ar", None, None, None, "WSRT.A.1", None),
        (6, "d/x_all.tim", "a.ar", 804.0, None, None, "kept", "kept too"),
        (7, "d/none.tim", "a.ar", None, None, None, None, None),
    ]
    out = {r["row"]: (r["sys"], r["grp"]) for r in ensure_sys_group(spark.createDataFrame(rows, schema)).collect()}
    assert out[1] == ("EFF.PX.1380", "EFF.PX.1400") and out[2] == ("EFF.PX.1382", "EFF.PX.1410")
    assert out[3] == ("UNK.PX.800", "UNK.PX.802") and out[4] == ("JBO.UNK.802", "JBO.UNK.802")
    assert out[5] == ("WSRT.A.1", "WSRT.UNK.802") and out[6] == ("kept", "kept too") and out[7] == ("UNK.UNK.UNK", "UNK.UNK.UNK")


def test_file_names_are_parsed_once_for_each_file(spark):
    schema = "row long, _timfile string, _timfile_base string, freq double, sys string, grp string"
    rows = [(1, "d/EFF.PX.1400.tim", None, 1380.0, None, None), (2, "d/x.tim", "NRT.B.800.tim", 801.0, None, None), (3, "d/EFF.PX.1400.tim", "", 1382.0, None, None), (4, None, None, 7.0, None, "LEAP.A.1"), (5, None, "JBO.C.900.tim", None, None, None)]
    out = ensure_sys_group(spark.createDataFrame(rows, schema))
    got = {r["row"]: (r["sys"], r["grp"]) for r in out.collect()}
    assert got == {1: ("EFF.PX.1380", "EFF.PX.1400"), 2: ("NRT.B.801", "NRT.B.800"), 3: ("EFF.PX.1382", "EFF.PX.1400"), 4: ("LEAP.UNK.7", "LEAP.A.1"), 5: ("JBO.C.UNK", "JBO.C.900")}
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_medians_together_are_those_alone(spark):
    df = spark.range(60).selectExpr("id % 3 as g", "case when id % 7 > 0 then cast(id * id % 31 as double) end as a", "case when id % 3 > 0 then cast(id as double) end as b")
    want = {g: tuple(r) for g, r in df.toPandas().groupby("g")[["a", "b"]].median().iterrows()}
    for direct in (1000, 5):
        got = {r["g"]: (r["a_"], r["b_"]) for r in exact_medians(df, ["g"], {"a_": "a", "b_": "b"}, direct_rows=direct).collect()}
        assert got[1] == want[1] and got[2] == want[2] and got[0] == (want[0][0], None)
