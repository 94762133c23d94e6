import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.cli import build_parser, config_of, main
from residua.options import Settings, options
from residua.operators.binned import detrend, orbital_cut, rescale, structure_test
from residua.operators.features import add_features, aligned_by_order, freq_bins
from residua.plans.pipeline import detection_stage, run_pipeline
from residua.plans.report import backend_rates, event_table, results_summary, structure_table
from residua.plans.resolve import membership_mask, resolve
from residua.plans.settings import read_settings, settings_text, write_settings
from residua.sources.observatory import parse_solar_text, read_sites
from residua.sources.par import ParFile, discover_all_tim, read_par, sky_position
from residua.sources.tim import parse_all_timfiles, permissive_records
from residua.sources.timing import FrameSource, clean_rows, write_rows

K = ["series_id", "grp"]


def by_id(df):
    return df.toPandas().sort_values("toa_id").reset_index(drop=True)


# --- binned models ------------------------------------------------------------------


def test_structure_and_detrend(series):
    x = np.repeat(np.arange(48) / 48.0, 1)
    zero = structure_test(series(59000.0 + np.arange(48), np.zeros(48), 1.0, orbital_phase=x), K, "orbital_phase").first()
    assert zero["chi2"] == pytest.approx(0) and zero["dof"] > 0 and not zero["present"]
    y = np.where(x < 0.5, 2.0, -1.0)
    df = series(59000.0 + np.arange(48), y, 1.0, orbital_phase=x)
    assert structure_test(df, K, "orbital_phase").first()["present"]
    out, models = detrend(df, K, ("orbital_phase", "missing"), min_per_bin=3)
    assert np.allclose(by_id(out)["resid_detr"], 0) and models.select("feature").distinct().count() == 1


def test_binned_models_against_numpy(series):
    rng = np.random.default_rng(2)
    x, y, s = rng.uniform(0, 180, 300), rng.normal(size=300), rng.uniform(0.5, 2, 300)
    x[5] = np.nan
    df = series(59000.0 + np.arange(300), y, s, solar_elongation_deg=x).withColumn("solar_elongation_deg", F.nanvl("solar_elongation_deg", F.lit(None)))
    edges = np.linspace(np.nanmin(x), np.nanmax(x), 13)
    b = np.clip(np.digitize(x, edges) - 1, 0, 11)
    b[5] = -1
    out = by_id(detrend(df, K, ("solar_elongation_deg",))[0])
    scaled = by_id(rescale(df, K, "solar_elongation_deg"))
    for k in range(12):
        m = b == k
        if m.sum() >= 5:
            assert np.allclose(out["resid_detr"][m], y[m] - np.average(y[m], weights=1 / s[m] ** 2))
            scale = 1.4826 * np.median(np.abs(y[m] - np.median(y[m])))
            assert np.allclose(scaled["resid_proc"][m], y[m] / scale) and np.allclose(scaled["sigma_proc"][m], s[m] / scale)
    assert out["resid_detr"][5] == y[5] and scaled["sigma_proc"][5] == s[5]


def test_orbital_cut(series):
    p = np.linspace(0, 1, 400, endpoint=False)
    d = np.minimum(np.abs(p - 0.25), 1 - np.abs(p - 0.25))
    df = series(59000.0 + np.arange(400), np.where(d < 0.1, 10.0, 0.5), 1.0, orbital_phase=p)
    cut = orbital_cut(df, ["series_id"], options("orbital", on=True)).first()["orbital_cut_phase"]
    assert 0.1 < cut < 0.15


# --- the stage --------------------------------------------------------------------------

SMALL = Settings(
    noise=options("noise", tau_days=0.0, fdr=0.01), transient=options("transient", points=4, gain=0.1, eta=2.0, decay_days=2.0),
    step=options("step", points=3, horizon_days=5.0, scope="backend"), dm_step=options("step", points=3, horizon_days=5.0, scope="backend"), robust=options("robust", z=6.0, scope="backend"),
)


def test_events_and_bad_points_exclude_each_other(series):
    i = np.arange(20)
    y = np.where(i >= 2, 5 * np.exp(-(i - 2) / 2.0), 0) + np.where(i >= 10, 3.0, 0) + np.where(i >= 14, 4.0, 0) + np.where(i == 1, 30.0, 0)
    df = series(59000.0 + i, y, 1.0, freq=100.0, orbital_phase=(i % 7) / 7.0, solar_elongation_deg=10.0 * i)
    out = by_id(detection_stage(df, SMALL).df)
    assert len(out) == 20 and out["event_member"].any() and not (out["event_member"] & out["bad_point"]).any()
    assert (out["outlier_any"] == (out["event_member"] | out["bad_point"])).all()


def test_preprocessing_changes_the_named_detectors(series):
    rng = np.random.default_rng(3)
    i = np.arange(240)
    phase = (i * 0.137) % 1.0
    y = 6 * np.sin(2 * np.pi * phase) + 0.5 * rng.normal(size=240)
    y[72] += 25
    df = series(59000.0 + i, y, 1.0, orbital_phase=phase, solar_elongation_deg=i % 180.0)
    quiet = dict(step=options("step", on=False), dm_step=options("step", on=False), transient=options("transient", gain=1e9), robust=options("robust", scope="backend"), noise=options("noise", tau_days=0.0))
    raw = by_id(detection_stage(df, Settings(**quiet)).df)
    done = detection_stage(df, Settings(**quiet, preproc=options("preproc", detrend=("orbital_phase",), used_by=("ou", "mad"))))
    proc = by_id(done.df)
    assert proc["robust_z"].iloc[72] > raw["robust_z"].iloc[72] and proc["robust_outlier"].iloc[72]
    assert proc["ou_used_resid_col"].iloc[0] == "resid_detr" and raw["ou_used_resid_col"].iloc[0] == "resid" and proc["step_used_resid_col"].iloc[0] == "resid"
    assert proc["preproc_tag"].iloc[0] == "detrend:orbital_phase" and done.models.count() > 0 and raw["preproc_tag"].iloc[0] == ""
    tested = by_id(detection_stage(df, Settings(**quiet, structure=options("structure", mode="test"))).df)
    assert (tested["bad_point"] == raw["bad_point"]).all() and tested["structure_present_orbital_phase"].all()
    table = structure_table(detection_stage(df, Settings(**quiet, structure=options("structure", mode="test"))).df, K, ("orbital_phase", "solar_elongation_deg"))
    assert table.count() == 2


def test_every_stage_at_once(series):
    rng = np.random.default_rng(4)
    i = np.arange(90)
    df = series(59000.0 + 7 * i, rng.normal(size=90), 1.0, freq=rng.uniform(400, 2000, 90), orbital_phase=(i % 10) / 10.0, solar_elongation_deg=2.0 * i)
    from dataclasses import replace

    cfg = Settings(structure=options("structure", mode="both"), preproc=options("preproc", rescale="solar_elongation_deg", used_by=("mad",)), gate=options("gate", on=True), orbital=options("orbital", on=True), transient=options("transient", scope="both"), robust=options("robust", scope="both"))
    cfg = cfg.but(solar={"on": True}, eclipse={"on": True}, glitch={"on": True}, bump={"on": True, "colour": False})
    out = detection_stage(df, cfg).df
    need = {"bad_ou", "bad_hard", "resid_detrended", "glitch_member", "gaussian_bump_member", "solar_event_member", "eclipse_event_member", "orbital_phase_bad", "event_member"}
    assert need <= set(out.columns) and out.count() == 90
    assert set(results_summary(out, K)) == {"totals", "events", "rates"}


# --- flags ---------------------------------------------------------------------------------


def test_flag_algebra(spark):
    cols = "toa_id long, grp string, bad boolean, robust_outlier boolean, bad_dm_dvt boolean, transient_id int, step_applicable boolean, step_informative boolean"
    rows = [
        (1, "g", True, False, False, -1, False, False), (2, "g", True, True, True, 0, False, False), (3, "g", False, True, False, -1, True, False),
        (4, "g", False, False, False, -1, True, True), (5, "g", None, None, None, None, None, None), (6, "h", False, False, True, -1, False, False),
    ]
    df = spark.createDataFrame(rows, cols)
    out = {r["toa_id"]: (r["bad_point"], r["event_member"], r["outlier_any"], r["bad_ou"]) for r in resolve(df).collect()}
    assert out == {1: (True, False, True, True), 2: (False, True, True, False), 3: (False, False, False, False), 4: (False, True, True, False), 5: (False, False, False, False), 6: (True, False, True, False)}
    assert resolve(df).where("toa_id = 2").first()["bad"]
    m = {r["toa_id"] for r in df.where(membership_mask(df, use_applicable=True)).collect()}
    assert m == {2, 3, 4}
    rates = {r["grp"]: r["rate_bad_point"] for r in backend_rates(resolve(df), ["grp"]).collect()}
    assert rates == {"g": 0.2, "h": 1.0}
    assert [(r["transient_id"], r["n_members"]) for r in event_table(df, ["grp"]).collect()] == [(0, 1)]


# --- features and files -----------------------------------------------------------------------


def test_par_and_phase(series, tmp_path):
    p = tmp_path / "x.par"
    p.write_text("PSR J1\nPB 2.0D0\nT0 58000.0\nRAJ 12:00:00\nDECJ -30:30:00\n# note\n")
    par = read_par(p)
    assert par.number("PB") == 2.0 and sky_position(par) == (180.0, -30.5)
    out = by_id(add_features(series([58000.0, 58001.0, 58002.0], [0.0] * 3, 1.0), par, options("covariates", freq_bins=8, elevation=True)))
    assert out["orbital_phase"].tolist() == [0.0, 0.5, 0.0] and out["solar_elongation_deg"].between(0, 180).all() and out["elevation_deg"].isna().all() and (out["freq_bin"] == 0).all()
    assert by_id(add_features(series([1.0], [0.0], 1.0), ParFile({})))["orbital_phase"].isna().all()
    assert sky_position(ParFile({"ELONG": "0", "ELAT": "0"})) == pytest.approx((0, 0)) and sky_position(ParFile({"GL": "0", "GB": "0"})) == pytest.approx((266.405, -28.936), abs=0.01)
    assert discover_all_tim("a/J1909.PAR").name == "J1909_all.tim" and discover_all_tim("J1").name == "J1_all.tim"


def test_freq_bins(series):
    f = np.array([400.0, 1200.0, 2000.0, np.nan])
    df = series([1.0, 2.0, 3.0, 4.0], [0.0] * 4, 1.0, freq=f).withColumn("freq", F.nanvl("freq", F.lit(None)))
    assert by_id(freq_bins(df, ["series_id"]))["freq_bin"].tolist() == [0, 4, 7, 7]


def test_sites_and_solar_text(spark, series, tmp_path):
    p = tmp_path / "sites.dat"
    p.write_text("# x y z name code\n1.0 2.0 3.0 Name alias ab\n6378137.0 0 0 OTHER\nbad line\n")
    sites = read_sites(spark, str(p))
    assert {r["name"] for r in sites.collect()} == {"name", "ab", "other"}
    df = series([58000.0, 58000.5], [0.0, 0.0], 1.0, tel=["other", "zz"])
    out = by_id(add_features(df, ParFile({"RAJ": "0:0:0", "DECJ": "0:0:0"}), options("covariates", elevation=True, airmass=True, parallactic=True), sites=sites))
    assert out["elevation_deg"].notna().tolist() == [True, False]
    text = parse_solar_text(spark, "noise\nSOLAR\t3.0\t200\nSOLAR\t1.0\t0\nSOLAR\t2.0\t45.0\n")
    zipped = by_id(aligned_by_order(series([2.0, 1.0, 3.0], [0.0] * 3, 1.0), text))
    assert zipped["solar_elongation_deg"].tolist() == [45.0, 0.0, 180.0]
    with pytest.raises(ValueError, match="values for"):
        aligned_by_order(series([1.0], [0.0], 1.0), text)


def test_timing_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "all.tim").write_text("FORMAT 1\nC note\n# x\nTIME 10\nINCLUDE sub/EFF.PX.1400.tim\nTIME -4\na.ar 1400 50000.5 1.5 eff -be X -cut -p -0.5 -be Y\nfoo\nTIME\n")
    (tmp_path / "sub" / "EFF.PX.1400.tim").write_text("50001.25 b.ar 1,400.5 50001.25 2.0D0 8\nTIME 5\nx y z 1400 50002 1 -cenfreq 1410.5\nINCLUDE\n")
    got = parse_all_timfiles(spark, str(tmp_path / "all.tim"))
    rows = {r["filename"]: r for r in got.df.collect()}
    assert got.stats["toa"] == 3 and got.stats["dropped"] == 3 and got.stats["comment"] == 2 and got.stats["control"] == 1 and got.stats["max_abs_offset_sec"] == 15.0
    assert rows["a.ar"]["_time_offset_sec"] == 6.0 and rows["b.ar"]["_time_offset_sec"] == 10.0 and rows["z"]["_time_offset_sec"] == 15.0
    assert rows["a.ar"]["flags"] == {"be": "Y", "cut": "true", "p": "-0.5"} and rows["a.ar"]["tel"] == "eff" and rows["b.ar"]["freq"] == 1400.5 and rows["z"]["cenfreq"] == 1410.5
    assert rows["a.ar"]["sat_corr"] == pytest.approx(50000.5 + 6 / 86400)
    (tmp_path / "none.tim").write_text("C\n")
    with pytest.raises(RuntimeError, match="no TOA"):
        parse_all_timfiles(spark, str(tmp_path / "none.tim"))
    empty = spark.createDataFrame([], "line string, _timfile string, line_no int")
    assert permissive_records(empty).count() == 0


def test_whole_pipeline_settings_and_command_line(spark, series, tmp_path):
    rng = np.random.default_rng(5)
    t = 50000.0 + np.arange(60)
    toas = series(t, 1e-6 * rng.normal(size=60), 1e-6).drop("grp", "series_id")
    meta = toas.select(F.col("toa_id").alias("meta_id"), F.col("mjd"), F.col("mjd").alias("sat_corr"), "freq", F.lit("a.ar").alias("filename"), F.lit("EFF.PX.1400.tim").alias("_timfile"))
    res = run_pipeline(spark, FrameSource(toas), meta, settings_out=str(tmp_path / "s.toml"))
    assert res.df.count() == 60 and res.df.first()["grp"] == "EFF.PX.1400"
    with pytest.raises(RuntimeError, match="without a metadata record"):
        run_pipeline(spark, FrameSource(toas), meta.where("meta_id > 0"))
    assert run_pipeline(spark, FrameSource(toas), meta.where("meta_id > 0"), cfg=Settings(drop_unmatched=True)).df.count() == 59
    cfg = config_of(build_parser().parse_args(["--toas", "x", "--out", "y", "--step-points", "7", "--gate-on", "true", "--preproc-detrend", "a,b", "--step-span-days", "3"]))
    assert cfg.step.points == 7 and cfg.gate.on and cfg.preproc.detrend == ("a", "b") and cfg.step.span_days == 3.0
    write_settings(cfg, tmp_path / "t.toml")
    assert read_settings(tmp_path / "t.toml") == cfg and "[step]" in settings_text(cfg)
    toas.write.parquet(str(tmp_path / "toas.parquet"))
    meta.write.parquet(str(tmp_path / "meta.parquet"))
    assert main(["--toas", str(tmp_path / "toas.parquet"), "--meta", str(tmp_path / "meta.parquet"), "--out", str(tmp_path / "out"), "--format", "csv", "--structure-mode", "none", "--transient-scope", "backend"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 60


def test_clean_rows(spark, tmp_path):
    df = spark.createDataFrame([(1.5, float("nan"), 2.0, 1400.0), (2.5, 1.0, 3.0, float("inf"))], "mjd double, resid double, sigma_us double, freq double")
    out = clean_rows(df).orderBy("mjd").collect()
    assert out[0]["resid"] is None and out[1]["freq"] is None and out[0]["sigma"] == 2e-6 and out[0]["day"] == 1 and out[0]["toa_id"] != out[1]["toa_id"]
    with pytest.raises(ValueError, match="missing columns"):
        clean_rows(df.drop("mjd"))
    write_rows(df.withColumn("m", F.create_map(F.lit("a"), F.lit("b"))), str(tmp_path / "j"), "json")
    lines = [x for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 2 and json.loads(lines[0])["m"] == {"a": "b"}
