"""Registered queries of covariates, flag resolution over all detectors, the detection stage and the pipeline, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.features import add_features, aligned_by_order
from residua.operators.steps import detect_step
from residua.options import Settings, options
from residua.plans import detector_queries as d
from residua.plans.detector_queries import BACKEND, CTE, SERIES
from residua.plans.feature_queries import MERGE_SQL, merge_meta
from residua.plans.pipeline import detection_stage, run_pipeline
from residua.plans.report_queries import FLAGS, annotated
from residua.plans.resolve import bad_points, clear_events, event_flags, outlier_flags
from residua.sources.observatory import SITES, all_sites
from residua.sources.par import ParFile
from residua.sources.tables import series_rows, table
from residua.sources.timing import FrameSource

#: a source and orbit for the covariates
PAR = ParFile({"RAJ": "04:37:15.8", "DECJ": "-47:15:09.1", "PB": "5.741", "T0": "50000.3"})
RA, DEC = "(4 + 37 / 60e0 + 15.8e0 / 3600) * 15", "-(47 + 15 / 60e0 + 9.1e0 / 3600)"


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase, elongation from the sun, height and angle over the horizon of the site, and frequency bin, of every row."""
    rows = series_rows(spark, sf_dir).drop("orbital_phase", "solar_elongation_deg").withColumn("tel", F.split("grp", r"\.")[0])
    cfg = options("covariates", elevation=True, airmass=True, parallactic=True, freq_bins=8)
    out = add_features(rows, PAR, cfg, sites=all_sites(spark), series=SERIES)
    shown = {"orbital_phase": 6, "solar_elongation_deg": 5, "elevation_deg": 5, "parallactic_angle_deg": 4}
    # near the horizon the airmass grows without bound
    high = F.when(F.col("elevation_deg") > 5, F.round("airmass", 5)).alias("airmass")
    return out.select("toa_id", *[F.round(c, n).alias(c) for c, n in shown.items()], high, "freq_bin")


_SITES = ", ".join(f"('{alias}', {x!r}::double, {y!r}::double, {z!r}::double)" for names, (x, y, z) in SITES.items() for alias in names.split())
_A, _F = "6378137e0", "(1 / 298.257223563e0)"
COVARIATE_SQL = CTE + f""",
site(name, x, y, z) as (values {_SITES}),
g as (select *, 51544.5e0 as j, {RA} as ra, {DEC} as de from s left join site on site.name = lower(trim(string_split(grp, '.')[1]))),
h as (select *, mjd - j as n, {_F} * (2 - {_F}) as e2, sqrt(x * x + y * y) as p, atan2(z * {_A}, sqrt(x * x + y * y) * {_A} * (1 - {_F})) as u, min(freq) over w as lo, max(freq) over w as hi from g window w as (partition by series_id)),
k as (select *, degrees(atan2(y, x)) as lon, atan2(z + e2 / (1 - e2) * {_A} * (1 - {_F}) * pow(sin(u), 3), p - e2 * {_A} * pow(cos(u), 3)) as lat,
  radians(280.460 + 0.9856474 * n + 1.915 * sin(radians(357.528 + 0.9856003 * n)) + 0.020 * sin(2 * radians(357.528 + 0.9856003 * n))) as l, radians(23.439 - 4e-7 * n) as tilt from h),
q as (select *, radians(280.46061837 + 360.98564736629 * n + 0.000387933 * (n / 36525) * (n / 36525) + lon - ra) as ha, radians(de) as d, radians(ra) as a from k),
v as (select *, case when ha is not null then greatest(-1, least(1, sin(lat) * sin(d) + cos(lat) * cos(d) * cos(ha))) end as up from q)
select toa_id, round((mjd - 50000.3) / 5.741 - floor((mjd - 50000.3) / 5.741), 6) as orbital_phase,
  case when l is not null then round(degrees(acos(greatest(-1, least(1, cos(l) * cos(d) * cos(a) + cos(tilt) * sin(l) * cos(d) * sin(a) + sin(tilt) * sin(l) * sin(d))))), 5) end as solar_elongation_deg,
  round(degrees(asin(up)), 5) as elevation_deg, round(degrees(atan2(sin(ha), tan(lat) * cos(d) - sin(d) * cos(ha))), 4) as parallactic_angle_deg,
  case when degrees(asin(up)) > 5 then round(1 / up, 5) end as airmass,
  cast(case when lo is null then null when lo = hi then 0 when freq is null then 7
    else greatest(0, least(len(list_filter(list_transform(range(0, 9), lambda i: case when i = 8 then hi else i * ((hi - lo) / 8) + lo end), lambda e: e <= freq)) - 1, 7)) end as integer) as freq_bin from v
"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elongations given in their own order, zipped with the rows in theirs."""
    rows = series_rows(spark, sf_dir).where("mjd is not null and solar_elongation_deg is not null")
    values = rows.select(F.col("mjd").alias("sat"), F.col("solar_elongation_deg").alias("angle"))
    return aligned_by_order(rows.select("toa_id", "mjd"), values, out="angle").select("toa_id", F.round("angle", 6).alias("angle"))


ALIGNED_SQL = CTE + """, r as (select toa_id, mjd, solar_elongation_deg as angle from s where mjd is not null and solar_elongation_deg is not null),
a as (select toa_id, row_number() over (order by mjd, toa_id) as k from r), b as (select angle, row_number() over (order by mjd, angle) as k from r)
select toa_id, round(angle, 6) as angle from a join b using (k)"""


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each pulsar without a metadata record."""
    found = merge_meta(spark, sf_dir).select("toa_id", "meta_id")
    return found.join(table(spark, sf_dir, "toas").select("toa_id", "psr"), "toa_id").groupBy("psr").agg(F.count("*").alias("n"), F.count_if(F.col("meta_id").isNull()).alias("n_unmatched"))


UNMATCHED_SQL = f"select psr, count(*) as n, count(*) filter (where meta_id is null) as n_unmatched from ({MERGE_SQL}) m join (select toa_id, psr from toas) t using (toa_id) group by psr"

#: flags and event numbers of every detector, each set on rows of its own pattern
_PATTERN = {
    "bad": 3, "robust_outlier": 5, "robust_global_outlier": 7, "bad_hard": 11, "bad_dm_dvt": 13, "exp_dip_member": 17, "solar_event_member": 19, "eclipse_event_member": 23,
    "gaussian_bump_member": 29, "glitch_member": 31, "step_informative": 37, "step_applicable": 18, "step_global_informative": 41, "step_global_applicable": 20,
    "dm_step_informative": 43, "dm_step_applicable": 22, "dm_step_global_informative": 47, "dm_step_global_applicable": 24,
}
_NUMBERS = {
    "transient_id": 53, "transient_global_id": 59, "exp_dip_global_id": 61, "gaussian_bump_id": 67, "glitch_id": 71, "step_id": 36, "step_global_id": 40, "dm_step_id": 44, "dm_step_global_id": 48,
}


def flag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolution of all detectors' flags, on patterns that meet in every combination."""
    rows = table(spark, sf_dir, "toas").select("toa_id")
    rows = rows.withColumns({c: F.col("toa_id") % n == 0 for c, n in _PATTERN.items()})
    rows = rows.withColumns({c: F.when(F.col("toa_id") % n == 0, F.lit(0)).otherwise(-1) for c, n in _NUMBERS.items()})
    out = event_flags(clear_events(bad_points(outlier_flags(rows))))
    return out.select("toa_id", "bad_ou", "bad_mad", "bad_hard", "bad_dm_dvt", "bad", "robust_outlier", "robust_global_outlier", "bad_point", "event_member", "outlier_any")


_flags = ", ".join([*[f"toa_id % {n} = 0 as {c}" for c, n in _PATTERN.items()], *[f"case when toa_id % {n} = 0 then 0 else -1 end as {c}" for c, n in _NUMBERS.items()]])
ALGEBRA_SQL = f"""
with f as (select toa_id, {_flags} from toas),
b as (select *, robust_outlier or robust_global_outlier as mad, bad or robust_outlier or robust_global_outlier or bad_hard or bad_dm_dvt as point,
  exp_dip_member or solar_event_member or eclipse_event_member or gaussian_bump_member or glitch_member as member,
  step_informative or step_applicable or step_id >= 0 or step_global_informative or step_global_applicable or step_global_id >= 0
    or dm_step_informative or dm_step_applicable or dm_step_id >= 0 or dm_step_global_informative or dm_step_global_applicable or dm_step_global_id >= 0 as stepped,
  transient_id >= 0 or transient_global_id >= 0 or exp_dip_global_id >= 0 as fired, gaussian_bump_id >= 0 or glitch_id >= 0 as shaped from f),
c as (select *, not (member or stepped or fired or shaped) as free from b),
e as (select *, point and free as p, (fired or step_informative or dm_step_informative or member) and not (point and free) as ev from c)
select toa_id, bad and free as bad_ou, mad and free as bad_mad, bad_hard and free as bad_hard, bad_dm_dvt, bad, robust_outlier and free as robust_outlier,
  robust_global_outlier and free as robust_global_outlier, p as bad_point, ev as event_member, p or ev as outlier_any from e
"""


def step_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each group's step in the sigma of its informative rows."""
    out = detect_step(series_rows(spark, sf_dir), BACKEND).where("step_applicable")
    shown = [F.round(F.max(f"step_{c}"), 4).alias(c) for c in ("z_min", "z_max", "frac_z_lt1")]
    return out.groupBy(*BACKEND).agg(F.count("*").alias("n"), *shown)


_members, _, _ = d.SQL["step_membership"].rpartition("\nselect toa_id")
DIAGNOSTICS_SQL = _members + """
select series_id, grp, count(*) as n, round(min(z) filter (where inf), 4) as z_min, round(max(z) filter (where inf), 4) as z_max,
  coalesce(round(avg(case when z < 1 then 1e0 else 0e0 end) filter (where inf), 4), 0) as frac_z_lt1 from i where app group by all"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows carry each resolved flag."""
    flags = ("bad_mad", "bad_dm_dvt", "bad_point", "event_member", "outlier_any")
    counted = annotated(spark, sf_dir).agg(*[F.count_if(F.col(c)).alias(c) for c in flags])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in flags])).alias("_t")).select("_t.flag", "_t.n")


TOTALS_SQL = "with" + FLAGS + "".join(
    f"{' union all ' * bool(i)}select '{c}' as flag, count(*) filter (where {c}) as n from fl" for i, c in enumerate(("bad_mad", "bad_dm_dvt", "bad_point", "event_member", "outlier_any"))
)


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors with their defaults, resolved."""
    out = detection_stage(series_rows(spark, sf_dir), Settings(), series=SERIES).df
    return out.select("toa_id", "bad_ou", "bad_mad", "bad_dm_dvt", "bad_point", "event_member", "outlier_any")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge with the metadata, keys and detection over the whole tables; rows without a record are dropped."""
    toas = series_rows(spark, sf_dir).withColumnRenamed("series_id", "psr").where("mjd is not null")
    out = run_pipeline(spark, FrameSource(toas), table(spark, sf_dir, "tim_meta"), cfg=Settings(drop_unmatched=True), series=["psr"], columns=["meta_id", "sys"]).df
    return out.select("toa_id", "meta_id", "sys", "grp", "bad_point", "event_member", "outlier_any")


QUERIES = {f.__name__: f for f in (covariates, aligned, unmatched, flag_algebra, step_diagnostics, totals, detection, pipeline)}
SQL = {"covariates": COVARIATE_SQL, "aligned": ALIGNED_SQL, "unmatched": UNMATCHED_SQL, "flag_algebra": ALGEBRA_SQL, "step_diagnostics": DIAGNOSTICS_SQL, "totals": TOTALS_SQL}
