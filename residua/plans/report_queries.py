"""Registered queries of fitted events, flag resolution and reports, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.options import options
from residua.operators.binned import with_structure
from residua.operators.bumps import detect_bumps
from residua.operators.covariate_events import detect_eclipse, detect_solar
from residua.operators.dips import detect_dips, dip_events
from residua.operators.glitches import detect_glitches
from residua.operators.outliers import hard_limit, robust_outliers
from residua.operators.steps import detect_step
from residua.operators.transients import detect_transients
from residua.plans import detector_queries as d
from residua.plans.detector_queries import BACKEND, CTE, SERIES, ps
from residua.plans.feature_queries import STRUCTURE_SQL
from residua.plans.report import backend_rates, dataset_summary, event_table, structure_table, top_groups
from residua.plans.resolve import membership_mask, resolve
from residua.session import checkpointed
from residua.sources.tables import series_rows, table

PLAIN_DIP = options("dip", colour=False)


def exp_dip_achromatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = dip_events(series_rows(spark, sf_dir), BACKEND, PLAIN_DIP)
    return ev.select(*BACKEND, "toa_id", F.round("t0", 6).alias("t0"), ps("amp").alias("amp_ps"), F.round("delta_chi2", 2).alias("delta_chi2"), "rank")


_DIPS = """
k0 as (select * from s where mjd is not null and resid is not null and sigma is not null),
c as (select a.toa_id, a.series_id, a.grp, a.mjd as t0, count(*) as n, max(b.mjd) as tl, sum(exp(-(b.mjd - a.mjd) / 30) * b.resid / (b.sigma * b.sigma)) as p, sum(exp(-2 * (b.mjd - a.mjd) / 30) / (b.sigma * b.sigma)) as q
  from k0 a join k0 b on a.series_id = b.series_id and a.grp = b.grp and b.mjd between a.mjd and a.mjd + 150 group by all),
k as (select *, p / q as amp, p * p / q as delta_chi2 from c where n >= 6 and p < 0 and tl - t0 >= 21 and p * p / q >= 25)
"""
_DIP_EVENTS = "{rcte}," + _DIPS + d._GREEDY_BACKEND.replace("35", "150")
DIP_SQL = d._fill(_DIP_EVENTS + "select series_id, grp, toa_id, round(t0, 6) as t0, cast(round(amp * 1e12) as bigint) as amp_ps, round(delta_chi2, 2) as delta_chi2, rank from v")


def exp_dip_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_dips(series_rows(spark, sf_dir), BACKEND, PLAIN_DIP)
    return out.select("toa_id", "exp_dip_global_id", F.round("exp_dip_global_t0", 6).alias("exp_dip_global_t0"), "exp_dip_member")


DIP_MEMBER_SQL = d._fill(_DIP_EVENTS + """,
m as (select s.toa_id, max((v.rank, v.t0)) as e from s join v on s.series_id = v.series_id and s.grp = v.grp and s.mjd between v.t0 and v.t0 + 150
  where abs(amp) * exp(-(mjd - v.t0) / 30) / sigma >= 1 or s.toa_id = v.toa_id group by s.toa_id)
select s.toa_id, coalesce(e[1], -1) as exp_dip_global_id, round(e[2], 6) as exp_dip_global_t0, e is not null as exp_dip_member from s left join m using (toa_id)""")


def exp_dip_chromatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = dip_events(series_rows(spark, sf_dir), SERIES, options("dip"))
    return ev.select(*SERIES, "toa_id", F.round("t0", 6).alias("t0"), F.round("alpha", 2).alias("alpha"), F.round("delta_chi2", 1).alias("delta_chi2"), "rank")


def solar_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_solar(series_rows(spark, sf_dir), SERIES, options("solar", on=True))
    p = "solar_event"
    return out.select("toa_id", f"{p}_year", F.round(f"{p}_tau", 2).alias(f"{p}_tau"), F.round(f"{p}_alpha", 2).alias(f"{p}_alpha"), F.round(f"{p}_delta_chi2", 1).alias(f"{p}_delta_chi2"), f"{p}_member")


def eclipse_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_eclipse(series_rows(spark, sf_dir), SERIES, options("eclipse", on=True))
    p = "eclipse_event"
    return out.select("toa_id", F.round(f"{p}_width", 3).alias(f"{p}_width"), F.round(f"{p}_alpha", 2).alias(f"{p}_alpha"), F.round(f"{p}_delta_chi2", 1).alias(f"{p}_delta_chi2"), f"{p}_member")


def _bump_out(out: DataFrame) -> DataFrame:
    p = "gaussian_bump"
    return out.select("toa_id", f"{p}_id", f"{p}_model", F.round(f"{p}_t0", 6).alias(f"{p}_t0"), f"{p}_duration_days", F.round(f"{p}_delta_chi2", 1).alias(f"{p}_delta_chi2"), f"{p}_member")


def gaussian_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bumps of each group without a frequency dependence."""
    return _bump_out(detect_bumps(series_rows(spark, sf_dir), BACKEND, options("bump", on=True, colour=False)))


_TIMES = ", ".join(f"{60 + i * (1500 - 60) / 5!r}e0" for i in range(6))
_SHAPE = {
    "gaussian": "exp(-0.5 * pow(abs({t} - {c}) / ({l} / 6), 2))", "laplace": "exp(-abs({t} - {c}) / ({l} / 6))", "plateau": "exp(-greatest(0, abs({t} - {c}) - {l} / 6) / ({l} / 10))",
}
_shape_sums = ", ".join(f"sum({f} * b.resid / (b.sigma * b.sigma)) as p_{k}, sum({f} * {f} / (b.sigma * b.sigma)) as q_{k}" for k, f in ((k, v.format(t="b.mjd", c="a.mjd", l="l")) for k, v in _SHAPE.items()))
_gain = {k: f"p_{k} * p_{k} / q_{k}" for k in _SHAPE}
BUMP_SQL = CTE.replace("with s as", "with recursive s as", 1) + f""",
k0 as (select * from s where mjd is not null and resid is not null and sigma is not null),
w as (select a.toa_id, a.series_id, a.grp, a.mjd as t0, l, count(*) as n, sum(b.resid * b.resid / (b.sigma * b.sigma)) as null_chi2, min(b.mjd) as first, max(b.mjd) as last, {_shape_sums}
  from k0 a cross join (select unnest([{_TIMES}]) as l) d join k0 b on a.series_id = b.series_id and a.grp = b.grp and b.mjd between a.mjd - l / 2 and a.mjd + l / 2 group by all),
m as (select *, case when {_gain["gaussian"]} >= {_gain["laplace"]} and {_gain["gaussian"]} >= {_gain["plateau"]} then 'gaussian' when {_gain["laplace"]} >= {_gain["plateau"]} then 'laplace' else 'plateau' end as model from w where n >= 20 and null_chi2 >= 25),
k as (select toa_id, series_id, grp, t0, l, first, last, model, case model {" ".join(f"when '{x}' then p_{x} / q_{x}" for x in _SHAPE)} end as amp, case model {" ".join(f"when '{x}' then {_gain[x]}" for x in _SHAPE)} end as delta from m),
r as (select *, row_number() over (partition by series_id, grp order by delta desc, t0, toa_id, l) as o from k where delta >= 25),
g as (select series_id, grp, o, [{{'a': first, 'z': last, 'o': o}}] as kept from r where o = 1
  union all select g.series_id, g.grp, r.o, case when len(list_filter(g.kept, lambda x: x.a <= r.last and x.z >= r.first)) > 0 then g.kept else list_append(g.kept, {{'a': r.first, 'z': r.last, 'o': r.o}}) end
  from g join r on r.series_id = g.series_id and r.grp = g.grp and r.o = g.o + 1),
f as (select series_id, grp, unnest(arg_max(kept, o)).o as o from g group by series_id, grp),
v as (select r.*, cast(row_number() over (partition by r.series_id, r.grp order by r.o) - 1 as integer) as rank from r join f using (series_id, grp, o)),
c as (select s.toa_id, max((v.rank, v.t0, v.l, v.delta, v.model)) as e from s join v on s.series_id = v.series_id and s.grp = v.grp and s.sigma is not null and s.mjd between v.t0 - l / 2 and v.t0 + l / 2
  where abs(amp) * case model {" ".join(f"when '{x}' then {f.format(t='s.mjd', c='v.t0', l='l')}" for x, f in _SHAPE.items())} end / s.sigma >= 1 group by s.toa_id)
select s.toa_id, coalesce(e[1], -1) as gaussian_bump_id, e[5] as gaussian_bump_model, round(e[2], 6) as gaussian_bump_t0, e[3] as gaussian_bump_duration_days, round(e[4], 1) as gaussian_bump_delta_chi2,
  e is not null as gaussian_bump_member from s left join c using (toa_id)"""


def gaussian_bump_chromatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bumps of each series with a fitted power of frequency, the defaults."""
    return _bump_out(detect_bumps(series_rows(spark, sf_dir), SERIES, options("bump", on=True)))


def _glitch_out(out: DataFrame) -> DataFrame:
    return out.select("toa_id", "glitch_id", "glitch_model", F.round("glitch_t0", 6).alias("glitch_t0"), F.round("glitch_delta_chi2", 1).alias("glitch_delta_chi2"), "glitch_member")


def glitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glitches of at least 100 days in each group."""
    return _glitch_out(detect_glitches(series_rows(spark, sf_dir), BACKEND, options("glitch", on=True, least_days=100.0)))


def glitch_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glitches of each series, the defaults."""
    return _glitch_out(detect_glitches(series_rows(spark, sf_dir), SERIES, options("glitch", on=True)))


def _glitch_sql(keys: str, least: str) -> str:
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    fit = lambda aa, ab, bb, ay, by: (
        f"({bb} * {ay} - {ab} * {by}) / ({aa} * {bb} - {ab} * {ab})", f"({aa} * {by} - {ab} * {ay}) / ({aa} * {bb} - {ab} * {ab})", f"{aa} * {bb} - {ab} * {ab} > 1e-12 * abs({aa} * {bb})",
    )
    a1, b1, ok1 = fit("w", "wt", "wtt", "y", "ty")
    a2, b2, ok2 = fit("hh", "ht", "wtt", "hy", "ty")
    return CTE + f""",
k0 as (select * from s where mjd is not null and resid is not null),
c0 as (select *, row_number() over o as i, sum(resid) over o as cum, count(*) over (partition by {keys} order by mjd range between 180 preceding and current row) as back, count(*) over (partition by {keys} order by mjd) as upto,
  max(mjd) over (partition by {keys}) as t_last from k0 window o as (partition by {keys} order by mjd, toa_id rows unbounded preceding)),
p as (select a.toa_id, {", ".join("a." + k for k in keys.split(", "))}, a.mjd as t0, a.resid as y0, a.i, any_value(a.t_last) as t_last, any_value(a.upto) as own, count(*) as n, sum(1 / (b.sigma * b.sigma)) as w, sum((b.mjd - a.mjd) / (b.sigma * b.sigma)) as wt,
  sum(pow(b.mjd - a.mjd, 2) / (b.sigma * b.sigma)) as wtt, sum(b.resid / (b.sigma * b.sigma)) as y, sum((b.mjd - a.mjd) * b.resid / (b.sigma * b.sigma)) as ty,
  sum(exp(-2 * (b.mjd - a.mjd) / 30) / (b.sigma * b.sigma)) as hh, sum(exp(-(b.mjd - a.mjd) / 30) * (b.mjd - a.mjd) / (b.sigma * b.sigma)) as ht, sum(exp(-(b.mjd - a.mjd) / 30) * b.resid / (b.sigma * b.sigma)) as hy
  from c0 a join c0 b on {on} and b.mjd >= a.mjd where a.sigma is not null and b.sigma is not null group by all),
f as (select *, case when {ok1} then {a1} * y + {b1} * ty else -1 end as d1, case when {ok2} then {a2} * hy + {b2} * ty else -1 end as d2, {a1} as a1, {b1} as b1, {a2} as a2, {b2} as b2 from p where n >= 30),
q as (select * from f where greatest(d1, d2) >= 25),
z as (select q.toa_id, coalesce(min(b.mjd) filter (where b.cum - coalesce(g.cum, 0) >= 0), any_value(q.t_last)) as t_end from q
  left join c0 b on {on.replace("a.", "q.")} and b.mjd > q.t0
  left join c0 g on {on.replace("a.", "q.").replace("b.", "g.")} and g.i = greatest(q.own, b.upto - b.back) group by q.toa_id),
e as (select q.*, t_end from q join z using (toa_id) where t_end - t0 >= {least}),
x as (select e.toa_id, median(b.resid) as mid, mad(b.resid) as dev from e join c0 b on {on.replace("a.", "e.")} and b.mjd > e.t0 and b.mjd <= e.t_end group by e.toa_id),
o as (select e.*, row_number() over (partition by {keys} order by greatest(d1, d2) desc, i) as rk from e join x using (toa_id) where y0 > mid + 1.4826 * dev),
v as (select * from o where rk = 1)
select s.toa_id, case when m then 0 else -1 end as glitch_id, case when m then model end as glitch_model, case when m then round(t0, 6) end as glitch_t0, case when m then round(delta, 1) end as glitch_delta_chi2, m as glitch_member from (
  select s.toa_id, v.t0, case when d2 > d1 then 'peak_ramp' else 'step_ramp' end as model, greatest(d1, d2) as delta,
    coalesce(s.resid is not null and s.mjd >= v.t0 and abs(case when d2 > d1 then a2 * exp(-(s.mjd - v.t0) / 30) + b2 * (s.mjd - v.t0) else a1 + b1 * (s.mjd - v.t0) end) / s.sigma >= 1, false) as m
  from s left join v on {on.replace("a.", "s.").replace("b.", "v.")}) s"""


GLITCH_SQL, GLITCH_SERIES_SQL = _glitch_sql("series_id, grp", "100"), _glitch_sql("series_id", "1000")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust and hard outliers, steps and transients of each group, resolved."""
    rows = series_rows(spark, sf_dir)
    had = set(rows.columns)
    out = rows
    for made in (robust_outliers(rows, BACKEND), hard_limit(rows, SERIES), detect_step(rows, BACKEND), detect_transients(rows, BACKEND)):
        out = out.join(made.select("toa_id", *[c for c in made.columns if c not in had]), "toa_id", "left")
    return resolve(out)


def flag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir).select("toa_id", "bad_mad", "bad_dm_dvt", "bad_point", "event_member", "outlier_any")


FLAGS = f"""
a as (select r.toa_id, robust_outlier, h.bad_dm_dvt, step_applicable, step_informative, transient_id >= 0 as tr
  from ({d.SQL["robust_mad_group"]}) r join ({d.SQL["hard_detector"]}) h using (toa_id) join ({d.SQL["step_membership"]}) st using (toa_id) join ({d.SQL["transient_membership"]}) t using (toa_id)),
f as (select *, step_applicable or tr as claimed from a),
g as (select toa_id, robust_outlier and not claimed as bad_mad, bad_dm_dvt, (robust_outlier or bad_dm_dvt) and not claimed as bad_point, step_informative or tr as ev, tr from f),
fl as (select toa_id, bad_mad, bad_dm_dvt, bad_point, ev and not bad_point as event_member, bad_point or (ev and not bad_point) as outlier_any, tr from g)
"""
FLAG_SQL = "with" + FLAGS + "select toa_id, bad_mad, bad_dm_dvt, bad_point, event_member, outlier_any from fl"


def event_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_rows(spark, sf_dir)
    out = detect_step(rows, BACKEND).join(detect_transients(rows, BACKEND).select("toa_id", "transient_id"), "toa_id")
    return out.select("toa_id", membership_mask(out).alias("member"), membership_mask(out, use_applicable=True).alias("member_or_applicable"))


MASK_SQL = f"""select toa_id, step_informative or transient_id >= 0 as member, step_applicable or transient_id >= 0 as member_or_applicable
from ({d.SQL["step_membership"]}) st join ({d.SQL["transient_membership"]}) t using (toa_id)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backend_rates(annotated(spark, sf_dir), BACKEND)
    return out.select(*BACKEND, "n", "n_bad_point", "n_event_member", F.round("rate_outlier_any", 6).alias("rate_outlier_any"))


RATES_SQL = CTE + "," + FLAGS + """select series_id, grp, count(*) as n, count(*) filter (where bad_point) as n_bad_point, count(*) filter (where event_member) as n_event_member,
round(avg(case when outlier_any then 1e0 else 0e0 end), 6) as rate_outlier_any from s join fl using (toa_id) group by all"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = event_table(detect_transients(series_rows(spark, sf_dir), BACKEND), BACKEND)
    return out.select(*BACKEND, "transient_id", F.round("transient_t0", 6).alias("transient_t0"), "n_members")


EVENT_TABLE_SQL = f"""{CTE} select series_id, grp, transient_id, min(transient_t0) as transient_t0, count(*) as n_members from s join ({d.SQL["transient_membership"]}) t using (toa_id) where transient_id >= 0 group by all"""


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = options("structure", mode="test")
    out = structure_table(checkpointed(with_structure(series_rows(spark, sf_dir), BACKEND, cfg)), BACKEND, cfg.test)
    return out.select(*BACKEND, "feature", F.round("chi2", 3).alias("chi2"), F.col("dof").cast("bigint").alias("dof"), F.round("p", 6).alias("p"), "present")


STRUCTURE_TABLE_SQL = f"""{CTE}, g as (select distinct series_id, grp from s), f as (select unnest(['solar_elongation_deg', 'orbital_phase']) as feature), t as ({STRUCTURE_SQL})
select g.series_id, g.grp, f.feature, chi2, coalesce(dof, 0) as dof, p, coalesce(present, false) as present
from g cross join f left join t on t.series_id = g.series_id and t.grp = g.grp and t.feature = f.feature"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_summary(table(spark, sf_dir, "tim_meta"), matched="sat_corr")


SUMMARY_SQL = "select count(*) as n_rows, cast(18 as integer) as n_cols, count(*) filter (where sat_corr is null) as n_unmatched, count(distinct grp) as n_groups from tim_meta"


def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    return top_groups(table(spark, sf_dir, "toas"))


LARGEST_SQL = "select grp, count(*) as n from toas group by grp order by n desc, grp nulls first limit 20"

QUERIES = {
    f.__name__: f
    for f in (
        exp_dip_achromatic, exp_dip_membership, exp_dip_chromatic, solar_event, eclipse_event, gaussian_bump, gaussian_bump_chromatic, glitch, glitch_series, flag_resolution, event_mask, rates, events,
        structures, summary, largest_groups,
    )
}
SQL = {
    "gaussian_bump": BUMP_SQL, "glitch": GLITCH_SQL, "glitch_series": GLITCH_SERIES_SQL,
    "exp_dip_achromatic": DIP_SQL, "exp_dip_membership": DIP_MEMBER_SQL, "flag_resolution": FLAG_SQL, "event_mask": MASK_SQL, "rates": RATES_SQL,
    "events": EVENT_TABLE_SQL, "structures": STRUCTURE_TABLE_SQL, "summary": SUMMARY_SQL, "largest_groups": LARGEST_SQL,
}
