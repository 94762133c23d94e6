import numpy as np
import pandas as pd
import pytest

from residua.operators.series_faults import FaultConfig, chunk_faults, find_faults


def made(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    t = np.sort(50000 + rng.uniform(0, 400, n))
    y = 2e-5 + 1e-6 * rng.standard_normal(n) + 5e-6 * np.sin(t / 80) + np.where(t > 50200, 3e-5, 0)
    return pd.DataFrame({"toa_id": np.arange(n), "psr": "P", "grp": "G", "mjd": t, "resid": y, "sigma": 1e-6})


def kinds(spark, pdf, **cfg):
    out = find_faults(spark.createDataFrame(pdf), cfg=FaultConfig(**cfg)).collect()
    assert len({r["toa_id"] for r in out}) == len(out)
    return {r["toa_id"]: r["kind"] for r in out}


@pytest.fixture
def planted():
    pdf = made()
    pdf.loc[[100, 700, 701, 1500, 2990], "resid"] += [5e-5, -4e-5, 4e-5, 6e-5, 3e-5]
    pdf.loc[1000:1007, "resid"] = pdf.loc[1000, "resid"]
    pdf.loc[2000, "resid"] = np.inf
    pdf.loc[2001, "sigma"] = -1.0
    pdf.loc[2002, "mjd"] = 1.0
    want = {100: "spike", 700: "spike", 701: "spike", 1500: "spike", 2990: "spike", 2000: "impossible", 2001: "impossible", 2002: "impossible"}
    return pdf, want | {i: "stuck" for i in range(1000, 1008)}


def test_all_kinds(spark, planted):
    pdf, want = planted
    assert kinds(spark, pdf) == want


@pytest.mark.parametrize("rows", [300, 997])
def test_chunks_of_one_source_give_the_same(spark, planted, rows):
    pdf, want = planted
    assert kinds(spark, pdf, chunk_rows=rows) == want


def test_steps_and_drift_are_normal(spark):
    assert kinds(spark, made(seed=2)) == {}


def test_nulls_placeholders_and_repeats(spark):
    pdf = made(600)
    pdf.loc[50, "resid"] += 1e-4
    twice = pd.concat([pdf, pdf.loc[[50]].assign(toa_id=5000)], ignore_index=True)
    assert kinds(spark, twice) == {50: "spike", 5000: "spike"}
    df = pdf.astype({"sigma": object, "grp": object, "resid": object})
    df.loc[50, "sigma"] = None
    df.loc[60, "resid"] = None
    df.loc[61, "grp"] = "unknown"
    schema = "toa_id long, psr string, grp string, mjd double, resid double, sigma double"
    rows = [tuple(None if v is None else v for v in r) for r in df[["toa_id", "psr", "grp", "mjd", "resid", "sigma"]].itertuples(index=False, name=None)]
    assert {r["toa_id"] for r in find_faults(spark.createDataFrame(rows, schema)).collect()} == set()
    assert find_faults(spark.createDataFrame([], schema)).count() == 0


def test_few_rows(spark):
    assert kinds(spark, made(2)) == {}


def test_dense_times_are_cut_and_chunk_numbers_have_no_gaps(spark, planted):
    """All rows of a long span within one bin: it is cut again, and every halo finds its neighbour."""
    pdf, want = planted
    pdf["mjd"] = np.where(pdf["mjd"].between(40000, 70000), 50000 + (pdf["mjd"] - 50000) / 1e5, pdf["mjd"])
    far = pd.DataFrame({"toa_id": [9000], "psr": "P", "grp": "G", "mjd": [69000.0], "resid": [5e-5], "sigma": [1e-6]})
    whole = kinds(spark, pd.concat([pdf, far]))
    assert {k for k in whole if k < 9000} >= set(want) - {1500, 2990}
    assert kinds(spark, pd.concat([pdf, far]), chunk_rows=250) == whole


def test_vanishing_innovations_are_stuck(spark):
    """A stretch that all but stands still, though no two readings are equal."""
    pdf = made(3000, seed=4)
    rng = np.random.default_rng(5)
    pdf.loc[1200:1499, "resid"] = pdf.loc[1200, "resid"] + 1e-18 * rng.standard_normal(300)
    assert pdf.loc[1200:1499, "resid"].nunique() > 250
    assert kinds(spark, pdf) == {i: "stuck" for i in range(1200, 1500)}
    assert kinds(spark, pdf, vanish=0.0) == {}


def test_the_filter_decides_spikes():
    """Without the update of the level (no filter) the same rows are no longer told from drift."""
    pdf = made(3000, seed=6)
    pdf["resid"] += 2e-4 * (pdf["mjd"] - 50000) / 400  # drift of many scatters
    pdf.loc[[500, 1800], "resid"] += 4e-5
    a = [pdf[c].to_numpy() for c in ("mjd", "resid", "sigma")]
    assert np.flatnonzero(chunk_faults(*a, FaultConfig())[1]).tolist() == [500, 1800]
    assert np.flatnonzero(chunk_faults(*a, FaultConfig(drift_row=0.0, drift_day=0.0, gate=1e9))[1]).tolist() != [500, 1800]
