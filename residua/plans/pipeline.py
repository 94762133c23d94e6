"""The detection stage and the whole pipeline.

The stage works on a narrow base of series columns that is written once.  What
detectors find for a series or group is joined to the rows by its keys, and only
members of events by row id, so no detector recomputes another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.options import Settings
from residua.operators.asof import auto_tolerance, merge_time_and_meta, unmatched_sample
from residua.operators.binned import detrend, preprocess, with_orbital_cut, with_structure
from residua.operators.blocks import largest_group
from residua.operators.bumps import detect_bumps
from residua.operators.covariate_events import detect_eclipse, detect_solar
from residua.operators.dips import dip_members, with_dips
from residua.operators.features import add_features
from residua.operators.glitches import detect_glitches
from residua.operators.keys import ensure_sys_group
from residua.operators.ou import detect_bad, innovations
from residua.operators.outliers import hard_limit, robust_outliers, sigma_gate
from residua.operators.steps import Scan, best_steps_of, chromatic_scale, detect_global_step, step_members
from residua.operators.transients import detect_global_transients, detect_transients
from residua.plans.resolve import bad_points, clear_events, event_flags, outlier_flags
from residua.session import checkpointed
from residua.sources.par import ParFile
from residua.sources.timing import TimingSource

DETECTORS = ("ou", "transient", "mad", "step", "dmstep")
#: columns that are read besides those that the settings name: by detectors, by the keys and covariates; and how the names of flags begin
READ = ("toa_id", "grp", "mjd", "day", "freq", "resid", "sigma", "orbital_phase", "solar_elongation_deg")
KEYED_BY = ("filename", "_timfile", "_timfile_base", "cenfreq", "be", "i", "r", "sys", "tel")
FLAGS = ("bad", "robust", "step", "dm_step", "transient", "exp_dip", "solar_event", "eclipse_event", "gaussian_bump", "glitch", "outlier", "event_member")


@dataclass(frozen=True)
class QCResult:
    """The annotated rows and the fitted models of preprocessing, if any."""

    df: DataFrame
    models: DataFrame | None


def detection_stage(df: DataFrame, cfg: Settings = Settings(), *, series: list[str] | None = None, group: str = "grp", row_id: str = "toa_id") -> QCResult:
    """All detectors and the resolved flags over series rows.

    ``series`` are the keys of one object (a pulsar); "backend" scope means
    (series, group), "global" scope the series.  Rows with a null group are
    taken as group UNK.  Row ids must be unique.
    """
    series = series or ["series_id"]
    backend = [*series, group]
    rows = df.withColumn(group, F.coalesce(F.col(group), F.lit("UNK")))
    base = "resid"
    struct = cfg.structure
    by = [*series, *(struct.by or (group,))]
    if struct.mode in ("detrend", "both"):
        rows, _ = detrend(rows, by, struct.detrend, out="resid_detrended", nbins=struct.bins, min_per_bin=struct.per_bin, circular=struct.circular)
        base = "resid_detrended"
    if struct.mode in ("test", "both"):
        rows = with_structure(rows, by, struct, resid=base)
    rows, made_r, made_s, models = preprocess(rows, _per_series(cfg, series), resid=base)
    pick = lambda d: (made_r, made_s) if d in cfg.preproc.used_by and made_r else (base, "sigma")
    used = {d: pick(d) for d in DETECTORS}
    ro, so = used["ou"]
    had = list(rows.columns)
    # written once, with the innovations, for all that follows
    made = checkpointed(innovations(rows.select(*had), backend, tau=cfg.noise.tau_days, resid=ro, sigma=so))
    rows = made.select(*had)
    largest = largest_group(rows, series)
    out = flagged = detect_bad(rows, backend, cfg.noise, resid=ro, sigma=so, made=made)
    bad = [c for c in flagged.columns if c not in had]
    for d, (r, s) in used.items():
        out = out.withColumns({f"{d}_used_resid_col": F.lit(r), f"{d}_used_sigma_col": F.lit(s)})

    def annotate(new: DataFrame) -> None:
        """Joins the columns that a detector added to the rows."""
        nonlocal out
        out = out.join(new.select(row_id, *[c for c in new.columns if c not in had]), row_id, "left")

    both = lambda scope, which: scope in (which, "both")
    (r, s), (rd, sd) = used["step"], used["dmstep"]
    scans = {"step": (cfg.step, Scan(cfg.step, r, s)), "dm_step": (cfg.dm_step, Scan(cfg.dm_step, rd, sd, chromatic_scale()))}
    steps = {}
    for scope, keys in (("global", series), ("backend", backend)):
        wanted = {n: scan for n, (c, scan) in scans.items() if c.on and both(c.scope, scope)}
        steps[scope] = best_steps_of(rows, keys, wanted, row_id=row_id) if wanted else {}
    for n, ev in steps["global"].items():
        c, scan = scans[n]
        out = detect_global_step(rows, series, group, c, prefix=f"{n}_global", resid=scan.resid, sigma=scan.sigma, scale=scan.scale, events=ev, into=out, largest=largest)
    rt, st = used["transient"]
    if both(cfg.transient.scope, "global"):
        annotate(detect_global_transients(rows, series, group, cfg.transient, resid=rt, sigma=st))
    dip_keys = {"backend": backend}.get(cfg.dip.scope, series)
    dips = [dip_members(rows, dip_keys, cfg.dip, resid=rt, sigma=st)]
    if cfg.dip.scope == "both":
        own = dip_members(rows, backend, cfg.dip, resid=rt, sigma=st, prefix="exp_dip_backend")
        dips.append(own.withColumnRenamed("exp_dip_member", "_own"))
    if cfg.glitch.on or cfg.bump.on:  # others read them, too
        dips = [checkpointed(d) for d in dips]

    def dipped(to: DataFrame) -> DataFrame:
        to = with_dips(to, dips[0], row_id=row_id)
        if len(dips) > 1:
            to = to.join(dips[1], row_id, "left").fillna(-1, subset=["exp_dip_backend_id"])
            to = to.withColumn("exp_dip_member", F.col("exp_dip_member") | F.coalesce("_own", F.lit(False))).drop("_own")
        return to

    out = dipped(out)
    claimed = dipped(rows).select(*had, F.col("exp_dip_member").alias("_taken"))
    if cfg.glitch.on:
        found = detect_glitches(claimed, series, cfg.glitch, exclude=F.col("_taken"), resid=rt, sigma=st).drop("_taken")
        glitches = checkpointed(found.select(row_id, *[c for c in found.columns if c not in had]))
        annotate(glitches)
        claimed = claimed.join(glitches.select(row_id, F.col("glitch_member").alias("_g")), row_id, "left")
        claimed = claimed.withColumn("_taken", F.col("_taken") | F.coalesce("_g", F.lit(False))).drop("_g")
    rm, sm = used["mad"]
    if cfg.robust.on and both(cfg.robust.scope, "global"):
        out = robust_outliers(rows, series, resid=rm, z_thresh=cfg.robust.z, prefix="robust_global", into=out, largest=largest)
    after = len(out.columns)
    if both(cfg.transient.scope, "backend"):
        out = detect_transients(flagged, backend, cfg.transient, use=~F.coalesce(F.col("bad"), F.lit(False)), resid=rt, sigma=st, into=out)
    for n, ev in steps["backend"].items():
        c, scan = scans[n]
        out = step_members(rows, ev, backend, c, prefix=n, sigma=scan.sigma, scale=scan.scale, into=out, largest=largest)
    if cfg.robust.on and both(cfg.robust.scope, "backend"):
        out = robust_outliers(rows, backend, resid=rm, z_thresh=cfg.robust.z, into=out, largest=largest)
    out = hard_limit(rows, series, resid=ro, sigma=so, into=out)
    if cfg.solar.on:
        annotate(detect_solar(rows, series, cfg.solar, resid=ro, sigma=so))
    if cfg.eclipse.on:
        annotate(detect_eclipse(rows, series, cfg.eclipse, resid=ro, sigma=so))
    if cfg.bump.on:
        annotate(detect_bumps(claimed, series, cfg.bump, exclude=F.col("_taken"), resid=ro, sigma=so).drop("_taken"))
    names = [c for c in out.columns if c not in bad and c not in had]
    k = after - len(had) - len(bad)  # where those of the noise have always been
    out = out.select(*had, *names[:k], *bad, *names[k:])
    out = outlier_flags(out)
    if cfg.gate.on:
        out = sigma_gate(out, cfg.gate, resid=ro, sigma=so)
    out = clear_events(bad_points(out))
    if cfg.orbital.on:
        out = with_orbital_cut(out, series, cfg.orbital, resid=ro, sigma=so)
    return QCResult(event_flags(out), models)


def _per_series(cfg: Settings, series: list[str]):
    """Preprocessing conditions hold within a series."""
    return cfg.preproc.but(within=(*series, *[c for c in cfg.preproc.within if c not in series]))


def _read(columns: list[str], cfg: Settings, named: list[str]) -> list[str]:
    """Those of the columns that the stages after the merge may read, and the named ones."""
    set_to = {v for stage in cfg for _, value in stage.items for v in (value if isinstance(value, tuple) else (value,)) if isinstance(v, str)}
    return [c for c in columns if c in {*named, *READ, *set_to} or c.startswith(FLAGS)]


def run_pipeline(spark: SparkSession, source: TimingSource, meta: DataFrame, *, par: ParFile | None = None, cfg: Settings = Settings(), series: list[str] | None = None, max_offset_sec: float = 0.0, sites: DataFrame | None = None, settings_out: str | None = None, columns: list[str] | None = None) -> QCResult:
    """Timing rows, metadata, keys, covariates and detection in one.

    Rows without a metadata record raise an error, or are dropped where the
    configuration says so.  With ``columns``, only these of the columns that no
    stage reads are carried along; rows and what is found for them are the same.
    """
    if settings_out:
        from residua.plans.settings import write_settings

        write_settings(cfg, settings_out)
    toas = source.rows(spark)
    series = series or (["psr"] if "psr" in toas.columns else [])
    if not series:
        toas, series = toas.withColumn("series_id", F.lit("all")), ["series_id"]
    merge = cfg.merge.but(tolerance_days=auto_tolerance(cfg.merge, max_offset_sec))
    known = toas.drop(*[c for c in ("sys", "grp") if c in toas.columns and c in meta.columns])
    merged = merge_time_and_meta(known, meta, merge, entity=series[0] if series[0] in meta.columns else None)
    if columns is not None:
        merged = merged.select(*_read(merged.columns, cfg, [*series, *KEYED_BY, *columns]))
    merged = checkpointed(merged)
    if not cfg.drop_unmatched:
        lost = unmatched_sample(merged).collect()
        if lost:
            raise RuntimeError(f"rows without a metadata record, among them {[r.asDict() for r in lost]}")
    keyed = ensure_sys_group(merged.where(F.col("filename").isNotNull()))
    if par is not None:
        keyed = add_features(keyed, par, cfg.covariates, sites=sites, series=series)
    if columns is not None:
        keyed = keyed.select(*_read(keyed.columns, cfg, [*series, *columns]))
    return detection_stage(keyed, cfg, series=series)
