"""Detectors share passes over the rows, and rows meet by row id only for members of events."""

import numpy as np
from pyspark.sql import functions as F

from residua.operators.steps import Scan, best_steps, best_steps_of, chromatic_scale
from residua.options import Settings, options
from residua.operators.transients import chunk_starts
from residua.plans.pipeline import detection_stage, run_pipeline
from residua.sources.timing import FrameSource


def frame(series, n=400):
    rng = np.random.default_rng(4)
    t = np.sort(50000 + rng.uniform(0, 900, n))
    y = 1e-6 * rng.normal(size=n) + np.where(t > 50500, 4e-6, 0)
    df = series(t, y, 1e-6, freq=rng.choice([430.0, 1400.0], n), grp=np.array(["a", "b"])[np.arange(n) % 2])
    return df.withColumns({"resid": F.when(F.col("toa_id") % 17 != 0, F.col("resid")), "freq": F.when(F.col("toa_id") % 13 != 0, F.col("freq"))})


def test_scans_together_are_those_alone(series):
    df, keys, cfg = frame(series), ["series_id", "grp"], options("step", span_days=50.0)
    made = {"one": Scan(cfg), "two": Scan(options("dm_step"), scale=chromatic_scale())}
    got = best_steps_of(df, keys, made)
    for name, s in made.items():
        alone = best_steps(df, keys, s.cfg, scale=s.scale)
        assert sorted(got[name].collect()) == sorted(alone.collect()) and alone.count() == 2


def test_flags_join_rows_by_id_only_for_members(series):
    out = detection_stage(frame(series), Settings()).df
    assert out.columns.index("bad") < out.columns.index("transient_id") < out.columns.index("step_t0")
    flags = out.select("toa_id", "bad_ou", "bad_mad", "bad_point", "event_member", "outlier_any")
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert sum(x.count("toa_id#") == 2 for x in joins) <= 2  # nine: one for each detector
    assert "step_z_med" not in plan and "median" not in plan  # counts that nobody reads are not made
    assert flags.count() == 400


def test_columns_that_nobody_reads_are_not_carried(series):
    toas = frame(series).withColumnRenamed("series_id", "psr").withColumn("note", F.lit("n"))
    meta = toas.select("psr", "mjd", "freq", F.col("mjd").alias("sat_corr"), (F.col("toa_id") + 1000).alias("meta_id"), F.lit("a.ar").alias("filename"), F.lit("d/EFF.PX.1400.tim").alias("_timfile"), F.lit(1.0).alias("bw"))
    run = lambda **how: run_pipeline(toas.sparkSession, FrameSource(toas), meta, series=["psr"], **how).df
    whole, few = run(), run(columns=["meta_id"])
    assert {"note", "bw", "filename", "mjd_meta"} <= set(whole.columns) and not {"note", "bw", "filename", "mjd_meta"} & set(few.columns)
    shown = [c for c in whole.columns if c in few.columns]
    assert {"meta_id", "grp", "bad_point", "step_z_med", "transient_t0"} <= set(shown)
    assert sorted(map(str, few.select(shown).collect())) == sorted(map(str, whole.select(shown).collect()))


def test_windows_of_uneven_buckets_at_once():
    rng = np.random.default_rng(7)
    t = np.sort(np.concatenate([10.0 * k + rng.uniform(0, 10, n).round(1) for k, n in enumerate((1, 40, 0, 3, 300, 2, 9, 0, 0, 5))]))
    y, w, own = rng.normal(size=len(t)), rng.uniform(0.5, 2, len(t)), rng.random(len(t)) < 0.8
    at, amp, delta, n, last = chunk_starts(t, y, w, own, 2.0, 10.0)
    assert (at == np.flatnonzero(own)).all()
    for k, i in enumerate(at):
        inside = (t >= t[i]) & (t <= t[i] + 10.0)
        f = np.exp(-(t[inside] - t[i]) / 2.0)
        num, den = (w[inside] * y[inside] * f).sum(), (w[inside] * f * f).sum()
        assert np.allclose((amp[k], delta[k]), (num / den, num * num / den)) and (n[k], last[k]) == (inside.sum(), t[inside][-1])
