import numpy as np
import pytest

from residua.options import Settings, options
from residua.plans.pipeline import detection_stage


@pytest.mark.parametrize("scope, wanted", [("global", set()), ("backend", {"a"}), ("both", {"a"})])
def test_dip_of_one_group(series, scope, wanted):
    """Group a dips by 20 sigma; group b is flat and so precise that the series as a whole has no dip."""
    t = np.tile(55000.0 + 2 * np.arange(60), 2)
    grp = np.repeat(["a", "b"], 60)
    after = (t >= 55040) & (grp == "a")
    y = np.where(after, -20e-6 * np.exp(-(t - 55040) / 30), 0.0)
    df = series(t, y, np.where(grp == "a", 1e-6, 1e-9), grp=grp)
    cfg = Settings(dip=options("dip", colour=False, scope=scope), glitch=options("glitch", on=False), transient=options("transient", gain=1e12))
    out = detection_stage(df, cfg).df.where("exp_dip_member").select("grp").distinct().collect()
    assert {r["grp"] for r in out} == wanted
