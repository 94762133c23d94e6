import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import queries
from residua.operators.ou import innovations

N = 60


@pytest.fixture(scope="module")
def toas(spark, tmp_path_factory):
    """60 rows of one group; row 5 has no freq, row 6 an absurd one and an outlier, row 7 sigma 0, row 8 no resid, row 9 no mjd."""
    g = np.random.default_rng(3)
    pdf = pd.DataFrame({"toa_id": np.arange(N), "psr": "J", "mjd": 55000.25 + np.arange(N) / 24, "freq": 1400.0, "sigma": 1e-6, "resid": g.normal(0, 1e-6, N), "grp": "g"})
    pdf["orbital_phase"], pdf["solar_elongation_deg"] = 0.5, 90.0
    pdf.loc[5, "freq"], pdf.loc[6, ["freq", "resid"]], pdf.loc[7, "sigma"], pdf.loc[8, "resid"], pdf.loc[9, "mjd"] = None, (1e9, 5e-5), 0.0, None, None
    path = tmp_path_factory.mktemp("all_rows")
    pdf.to_parquet(path / "toas.parquet")
    return str(path), pdf


def by_id(df):
    return {r["toa_id"]: r for r in df.collect()}


def test_robust_mad_uses_every_resid(spark, toas):
    path, pdf = toas
    got = by_id(queries()["robust_mad_group"](spark, path))
    y = pdf["resid"].to_numpy()
    dev = y - np.nanmedian(y)
    z = 0.6745 * dev / np.nanmedian(np.abs(dev))
    assert len(got) == N and got[8]["robust_z_e4"] is None and got[6]["robust_outlier"]
    assert all(got[i]["robust_z_e4"] == pytest.approx(z[i] * 1e4, abs=1) for i in range(N) if i != 8)


def test_each_operator_leaves_out_only_what_it_lacks(spark, toas):
    path, _ = toas
    q = queries()
    hard = by_id(q["hard_detector"](spark, path))
    assert hard[6]["bad_dm_dvt"] and hard[5]["score"] is not None and hard[7]["score"] is None and hard[9]["score"] is not None
    assert by_id(q["gate"](spark, path))[6]["bad_hard"]
    ou = by_id(q["ou_innovations"](spark, path))
    assert len(ou) == N and {i for i in ou if ou[i]["e_ps"] is None} == {7, 8, 9}
    assert q["step_membership"](spark, path).count() == q["flag_resolution"](spark, path).count() == N


def test_a_row_without_value_is_no_predecessor(series):
    t, y = 55000 + np.arange(4) / 100, np.array([1.0, np.nan, 3.0, 4.0])
    df = series(t, y, 1.0).replace(float("nan"), None)
    got = by_id(innovations(df, ["series_id", "grp"], tau=0.02))
    assert got[1]["ou_e"] is None and got[2]["ou_e"] == pytest.approx(3 - np.exp(-1.0))
