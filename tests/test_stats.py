import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residua.functions import stats
from residua.functions.geometry import horizon, geodetic, solar_elongation, to_equatorial, vector_angle


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_normal_tails(spark):
    z = [0.0, 0.5, 1.0, 2.0, 3.5, 6.0]
    got = one(spark, *[stats.normal_two_sided(F.lit(x)) for x in z])
    assert np.allclose(list(got), [math.erfc(x / 2**0.5) for x in z], rtol=3e-7)
    sql = spark.sql("select " + ", ".join(stats.erfc_sql(f"{x}e0") + f" as c{i}" for i, x in enumerate(z))).first()
    assert np.allclose(list(sql), [math.erfc(x) for x in z], rtol=3e-7)
    up = one(spark, stats.normal_upper(F.lit(1.5)), stats.normal_upper(F.lit(-1.5)))
    assert np.isclose(up[0] + up[1], 1.0)


def test_chi2_tail(spark):
    lit = F.lit
    got = one(spark, stats.chi2_tail(lit(10.0), lit(10)), stats.chi2_tail(lit(30.0), lit(10)), stats.chi2_tail(lit(-1.0), lit(3)), stats.chi2_tail(lit(1.0), lit(0)))
    assert abs(got[0] - 0.4405) < 0.005 and abs(got[1] - 0.000857) < 1e-4 and got[2] == 1.0 and got[3] is None


@pytest.mark.parametrize("p", [[0.001, 0.008, 0.039, 0.041, 0.2, 0.9], [0.5, 0.6], [0.01, 0.01, 0.01], [0.03, None, 0.04]])
def test_fdr(spark, p):
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(p)], "i int, g string, p double")
    got = {r["i"] for r in stats.fdr_flags(df, ["g"], "p", 0.05, "f").where("f").collect()}
    known = sorted(x for x in p if x is not None)
    cut = max((x for k, x in enumerate(known, 1) if x <= 0.05 * k / len(known)), default=-1)
    assert got == {i for i, x in enumerate(p) if x is not None and x <= cut}


@given(st.floats(-3, 3), st.floats(0.5, 4))
def test_golden_section(peak, width):
    x, y = stats.golden_max(lambda v: -(((v - peak) / width) ** 2), -5.0, 5.0, 1e-6, 200)
    assert abs(x - peak) < 1e-4 and y <= 0


def test_time_and_phase(spark):
    got = one(spark, stats.mjd_of(F.to_timestamp(F.lit("2000-01-01 12:00:00"))), stats.year_of_mjd(F.lit(51544.5)), stats.year_of_mjd(F.lit(50000.0)), stats.folded_distance(F.lit(0.9), 0.25))
    assert got[0] == 51544.5 and got[1] == 2000 and got[2] == 1995 and abs(got[3] - 0.35) < 1e-12


def test_angles(spark):
    v = lambda x, y, z: (F.lit(x), F.lit(y), F.lit(z))
    got = one(spark, vector_angle(v(1.0, 0.0, 0.0), v(2.0, 0.0, 0.0)), vector_angle(v(1.0, 0.0, 0.0), v(-1.0, 0.0, 0.0)), vector_angle(v(1.0, 0.0, 0.0), v(0.0, 3.0, 0.0)), vector_angle(v(0.0, 0.0, 0.0), v(1.0, 0.0, 0.0)))
    assert np.allclose(list(got)[:3], [0, 180, 90]) and got[3] is None


def test_sun_and_coordinates(spark):
    # at the March equinox of 2020 (MJD 58928.16) the sun stands at ra 0, dec 0
    got = one(spark, solar_elongation(F.lit(58928.16), F.lit(0.0), F.lit(0.0)), solar_elongation(F.lit(58928.16), F.lit(90.0), F.lit(0.0)), solar_elongation(F.lit(58928.16), F.lit(180.0), F.lit(0.0)))
    assert got[0] < 0.1 and abs(got[1] - 90) < 0.1 and abs(got[2] - 180) < 0.1
    assert np.allclose(to_equatorial("ecliptic", 0.0, 0.0), (0.0, 0.0))
    assert np.allclose(to_equatorial("ecliptic", 90.0, 0.0), (90.0, 23.4392911))
    assert np.allclose(to_equatorial("galactic", 0.0, 0.0), (266.405, -28.936), atol=0.01)
    assert np.allclose(to_equatorial("galactic", 0.0, 90.0)[1], 27.12825, atol=1e-4)


def test_horizon(spark):
    lon, lat = geodetic(F.lit(0.0), F.lit(0.0), F.lit(6356752.3))
    north = horizon(F.lit(58000.0), F.lit(10.0), F.lit(30.0), lon, lat)
    got = one(spark, lat, north["elevation_deg"], north["airmass"], horizon(F.lit(58000.0), F.lit(10.0), F.lit(-30.0), lon, lat)["airmass"])
    assert np.isclose(got[0], 90.0) and np.isclose(got[1], 30.0, atol=1e-6) and np.isclose(got[2], 2.0) and got[3] is None
