"""Registered queries of the detectors over the timing rows, with SQL for the same results.

Floating results are given as integers of a fixed unit or rounded, since sums
run in different orders in different engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.options import options
from residua.functions.stats import erfc_sql
from residua.operators.blocks import exact_median
from residua.operators.ou import bad_days, detect_bad, innovations
from residua.operators.outliers import hard_limit, robust_outliers, sigma_gate
from residua.operators.steps import best_steps, chromatic_scale, detect_dm_step, detect_global_step, detect_step
from residua.operators.transients import detect_global_transients, detect_transients, scan_starts, transient_events
from residua.sources.tables import SERIES_SQL, series_rows

BACKEND = ["series_id", "grp"]
SERIES = ["series_id"]
STEP = options("step")
TRANSIENT = options("transient")
WIDTH = TRANSIENT.reach * TRANSIENT.decay_days
CTE = f"with s as ({SERIES_SQL.format(toas='toas')})"


def ps(c: Column | str) -> Column:
    """Seconds to whole picoseconds."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e12).cast("bigint")


def robust_mad_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_outliers(series_rows(spark, sf_dir), BACKEND)
    return out.select("toa_id", F.round(F.col("robust_z") * 1e4).cast("bigint").alias("robust_z_e4"), "robust_outlier")


def robust_mad_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust_outliers(series_rows(spark, sf_dir), SERIES, prefix="robust_global")
    return out.select("toa_id", F.round(F.col("robust_global_z") * 1e4).cast("bigint").alias("robust_global_z_e4"), "robust_global_outlier")


_MAD = """{cte},
m as (select *, median(resid) over (partition by {k}) as med from s),
d as (select *, median(abs(resid - med)) over (partition by {k}) as mad from m)
select toa_id, cast(round(0.6745 * (resid - med) / nullif(mad, 0) * 1e4) as bigint) as {p}_z_e4, coalesce(abs(0.6745 * (resid - med) / nullif(mad, 0)) >= 5, false) as {p}_outlier from d
"""


def hard_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hard_limit(series_rows(spark, sf_dir), SERIES)
    return out.select("toa_id", F.round("bad_dm_dvt_k", 6).alias("k"), F.round("bad_dm_dvt_score", 6).alias("score"), "bad_dm_dvt", "bad_dm_dvt_label")


HARD_SQL = """{cte},
k as (select series_id, greatest(1.0::double, avg(abs(resid) / sigma)) as k from s group by series_id)
select toa_id, round(k, 6) as k, round(abs(resid) / sigma, 6) as score, coalesce(abs(resid) / sigma > 4 * k, false) as bad_dm_dvt,
  case when abs(resid) / sigma > 4 * k then 'BAD_DM_DVT+20' else '' end as bad_dm_dvt_label from s join k using (series_id)
"""


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sigma_gate(series_rows(spark, sf_dir), options("gate", on=True))
    return out.select("toa_id", "outlier_gate_sigma", "outlier_gate_inlier", "bad_hard")


GATE_SQL = "{cte} select toa_id, 3.0::double as outlier_gate_sigma, coalesce(abs(resid) <= 3 * sigma, false) as outlier_gate_inlier, coalesce(not abs(resid) <= 3 * sigma, false) as bad_hard from s"


def ou_innovations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = innovations(series_rows(spark, sf_dir), BACKEND, tau=0.02)
    return out.select("toa_id", ps("ou_e").alias("e_ps"), F.round("ou_b", 6).alias("b"), F.round(F.sqrt("ou_a") * 1e12).cast("bigint").alias("root_a_ps"))


_OU = """{cte},
l as (select *, lag(mjd) over w as pt, lag(resid) over w as py, lag(sigma) over w as psig from s where mjd is not null and resid is not null and sigma is not null window w as (partition by series_id, grp order by mjd, toa_id)),
f as (select *, case when pt is null then 0 else exp(-(mjd - pt) / 0.02) end as phi from l),
v as (select toa_id, series_id, grp, mjd, day, resid - phi * coalesce(py, 0) as e, sigma * sigma + phi * phi * coalesce(psig, 0) * coalesce(psig, 0) as a, 1 - phi * phi as b from f)
"""
OU_SQL = _OU + "select s.toa_id, cast(round(e * 1e12) as bigint) as e_ps, round(b, 6) as b, cast(round(sqrt(a) * 1e12) as bigint) as root_a_ps from s left join v using (toa_id)"


def ou_bad_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad days with the extra noise fixed at 0."""
    made = innovations(series_rows(spark, sf_dir), BACKEND, tau=0.02)
    out = bad_days(made, BACKEND, z=F.col("ou_e") / F.sqrt("ou_a"), fdr_q=0.01, only_worst=True)
    return out.where("bad_day").select("toa_id", "bad_day", "bad")


OU_BAD_SQL = _OU + f""",
z as (select *, abs(e / sqrt(a)) as az from v),
t as (select series_id, grp, day, max(az) as tmax, arg_min(toa_id, (-az, mjd, toa_id)) as row_id from z group by all),
p as (select *, {erfc_sql("tmax / sqrt(2e0)")} as p from t),
k as (select *, row_number() over (partition by series_id, grp order by p) as k, count(*) over (partition by series_id, grp) as m from p),
c as (select *, max(case when p <= 0.01 * k / m then p end) over (partition by series_id, grp) as cut from k)
select s.toa_id, true as bad_day, s.toa_id = c.row_id as bad from s join c on s.series_id = c.series_id and s.grp = c.grp and s.day = c.day where c.p <= c.cut
"""


def ou_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector with the fitted extra noise of each group."""
    out = detect_bad(series_rows(spark, sf_dir), BACKEND)
    return out.select("toa_id", F.round("z", 4).alias("z"), F.round(F.sqrt("_q_hat") * 1e12).cast("bigint").alias("root_q_ps"), "bad_day", "bad")


def ou_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group how its noise came out: none, fitted (the robust spread of the innovations is 1) or at the bound of the search (above 1)."""
    made = detect_bad(series_rows(spark, sf_dir), BACKEND).where("z is not null").withColumn("_s2", F.col("sigma") * F.col("sigma"))
    off = made.join(exact_median(made, BACKEND, "z", "_m"), BACKEND).withColumn("_off", F.abs(F.col("z") - F.col("_m")))
    per = made.groupBy(*BACKEND).agg(F.max("_q_hat").alias("_q")).join(exact_median(off, BACKEND, "_off", "_mad"), BACKEND).join(exact_median(made, BACKEND, "_s2", "_top"), BACKEND)
    spread = 1.4826 * F.col("_mad")
    at_bound = (F.abs(F.col("_q") / (100 * F.col("_top")) - 1) < 1e-9) & (spread > 1)
    state = F.when(F.col("_q") == 0, "none").when(F.abs(spread - 1) < 1e-6, "fitted").when(at_bound, "bound").otherwise("off")
    return per.select(*BACKEND, state.alias("noise"))


NOISE_SQL = _OU.replace("1 - phi * phi as b from f", "1 - phi * phi as b, sigma from f") + """,
t as (select series_id, grp, 100 * median(sigma * sigma) as top, count(*) as n from v group by all),
m as (select series_id, grp, any_value(n) as n, 1.4826 * mad(e / sqrt(a)) as low, 1.4826 * mad(e / sqrt(a + top * b)) as high from v join t using (series_id, grp) group by all)
select series_id, grp, case when n < 10 or low <= 1 then 'none' when high > 1 then 'bound' else 'fitted' end as noise from m"""


def step_scan_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = best_steps(series_rows(spark, sf_dir), BACKEND, STEP)
    return ev.select(*BACKEND, F.round("t0", 6).alias("t0"), ps("amp").alias("amp_ps"), F.round("delta_chi2", 3).alias("delta_chi2"))


def dm_step_scan_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = best_steps(series_rows(spark, sf_dir), BACKEND, STEP, scale=chromatic_scale())
    return ev.select(*BACKEND, F.round("t0", 6).alias("t0"), F.round(F.col("amp") * 1e6).cast("bigint").alias("amp_us_mhz2"), F.round("delta_chi2", 3).alias("delta_chi2"))


_SCAN = """
r{n} as (select *, resid * {f} as y, 1 / (sigma * {f} * sigma * {f}) as w from s where mjd is not null and resid is not null and sigma is not null and {f} is not null),
c{n} as (select *, row_number() over o as i, count(*) over g as n, sum(w) over o - w as w1, sum(w * y) over o - w * y as y1, sum(w) over g as wa, sum(w * y) over g as ya, lag(mjd) over o as pt
  from r{n} window o as (partition by {k} order by mjd, toa_id), g as (partition by {k})),
d{n} as (select *, (pt + mjd) / 2 as t0, (ya - y1) / (wa - w1) - y1 / w1 as amp from c{n} where i > 20 and n - i + 1 >= 20),
q{n} as (select *, amp * amp / (1 / w1 + 1 / (wa - w1)) as dc from d{n}),
b{n} as (select {k}, arg_max(t0, (dc, -i)) as t0, arg_max(amp, (dc, -i)) as amp, max(dc) as delta_chi2 from q{n} group by {k} having max(dc) >= 25)
"""
_K = "series_id, grp"
STEP_SQL = "{cte}," + _SCAN.format(n=1, f="1", k=_K) + "select series_id, grp, round(t0, 6) as t0, cast(round(amp * 1e12) as bigint) as amp_ps, round(delta_chi2, 3) as delta_chi2 from b1"
DM_STEP_SQL = "{cte}," + _SCAN.format(n=1, f="freq * freq", k=_K) + "select series_id, grp, round(t0, 6) as t0, cast(round(amp * 1e6) as bigint) as amp_us_mhz2, round(delta_chi2, 3) as delta_chi2 from b1"


def _step_out(df: DataFrame, p: str) -> DataFrame:
    return df.select(
        "toa_id", f"{p}_id", f"{p}_applicable", f"{p}_informative", F.round(f"{p}_t0", 6).alias(f"{p}_t0"),
        F.round(f"{p}_delta_chi2", 3).alias(f"{p}_delta_chi2"), f"{p}_n_applicable", f"{p}_n_informative", F.round(f"{p}_z_med", 4).alias(f"{p}_z_med"),
    )


def step_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_out(detect_step(series_rows(spark, sf_dir), BACKEND, STEP), "step")


def dm_step_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_out(detect_dm_step(series_rows(spark, sf_dir), BACKEND, STEP), "dm_step")


_STEP_MEMBERS = """,
j as (select s.*, {b}.t0, {b}.amp, {b}.delta_chi2, coalesce(mjd >= t0 and mjd <= t0 + 3650, false) and amp is not null as app from s left join {b} using ({on})),
z as (select *, case when app then abs(amp) / ({f}) / sigma end as z from j),
i as (select *, coalesce(z > 1, false) as inf from z),
n as (select {on}, count(*) as na, count(*) filter (where inf) as ni, median(z) filter (where inf) as zm from i where app group by {on})
select toa_id, case when app then 0 else -1 end as {p}_id, app as {p}_applicable, inf as {p}_informative, round(t0, 6) as {p}_t0, round(delta_chi2, 3) as {p}_delta_chi2,
  coalesce(na, 0) as {p}_n_applicable, coalesce(ni, 0) as {p}_n_informative, round(zm, 4) as {p}_z_med from i left join n using ({on})
"""
STEP_MEMBERS_SQL = "{cte}," + _SCAN.format(n=1, f="1", k=_K) + _STEP_MEMBERS.format(b="b1", on=_K, f="1", p="step")
DM_STEP_MEMBERS_SQL = "{cte}," + _SCAN.format(n=1, f="freq * freq", k=_K) + _STEP_MEMBERS.format(b="b1", on=_K, f="freq * freq", p="dm_step")


def global_step_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_out(detect_global_step(series_rows(spark, sf_dir), SERIES, "grp", STEP), "step_global")


def global_dm_step_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step_out(detect_global_step(series_rows(spark, sf_dir), SERIES, "grp", STEP, prefix="dm_step_global", scale=chromatic_scale()), "dm_step_global")


_REGROUP = """,
u as (select r1.series_id, r1.grp, t0, delta_chi2, count(*) filter (where mjd < t0) as n1, count(*) filter (where mjd >= t0 and mjd <= t0 + 3650) as n2,
  sum(w * y) filter (where mjd < t0) / sum(w) filter (where mjd < t0) as m1,
  sum(w * y) filter (where mjd >= t0 and mjd <= t0 + 3650) / sum(w) filter (where mjd >= t0 and mjd <= t0 + 3650) as m2
  from r1 join b1 using (series_id) group by all),
e as (select series_id, grp, t0, delta_chi2, m2 - m1 as amp from u where n1 >= 20 and n2 >= 20)
"""
GLOBAL_STEP_SQL = "{cte}," + _SCAN.format(n=1, f="1", k="series_id") + _REGROUP + _STEP_MEMBERS.format(b="e", on=_K, f="1", p="step_global")
GLOBAL_DM_STEP_SQL = "{cte}," + _SCAN.format(n=1, f="freq * freq", k="series_id") + _REGROUP + _STEP_MEMBERS.format(b="e", on=_K, f="freq * freq", p="dm_step_global")


def transient_scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan_starts(series_rows(spark, sf_dir), BACKEND, tau=7.0, width=WIDTH, min_points=6, threshold=25.0)
    return c.select("toa_id", *BACKEND, F.round("t0", 6).alias("t0"), ps("amp").alias("amp_ps"), F.round("delta_chi2", 2).alias("delta_chi2"), "n")


_CANDS = """
k0 as (select * from s where mjd is not null and resid is not null and sigma is not null),
c as (select a.toa_id, a.series_id, a.grp, a.mjd as t0, count(*) as n, sum(exp(-(b.mjd - a.mjd) / 7) * b.resid / (b.sigma * b.sigma)) as p, sum(exp(-2 * (b.mjd - a.mjd) / 7) / (b.sigma * b.sigma)) as q
  from k0 a join k0 b on {on} and b.mjd between a.mjd and a.mjd + 35 group by all),
k as (select *, p / q as amp, p * p / q as delta_chi2 from c where n >= 6 and p * p / q >= 25)
"""
_ON_BACKEND = "a.series_id = b.series_id and a.grp = b.grp"
CANDS_SQL = "{cte}," + _CANDS.format(on=_ON_BACKEND) + "select toa_id, series_id, grp, round(t0, 6) as t0, cast(round(amp * 1e12) as bigint) as amp_ps, round(delta_chi2, 2) as delta_chi2, n from k"


def transient_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = transient_events(series_rows(spark, sf_dir), BACKEND, TRANSIENT)
    return ev.select(*BACKEND, "toa_id", F.round("t0", 6).alias("t0"), F.round("delta_chi2", 2).alias("delta_chi2"), "rank")


_GREEDY = """,
r as (select *, row_number() over (partition by {k} order by delta_chi2 desc, t0, toa_id) as o from k),
g as (select {rk}, o, [t0] as kept, [toa_id] as ids from r where o = 1
  union all select {gk}, r.o, case when len(list_filter(g.kept, lambda x: x >= r.t0 - 35 and x <= r.t0 + 35)) > 0 then g.kept else list_append(g.kept, r.t0) end,
    case when len(list_filter(g.kept, lambda x: x >= r.t0 - 35 and x <= r.t0 + 35)) > 0 then g.ids else list_append(g.ids, r.toa_id) end
  from g join r on {join} and r.o = g.o + 1),
f as (select {k}, unnest(arg_max(ids, o)) as toa_id from g group by {k}),
v as (select r.*, cast(row_number() over (partition by {vk} order by r.delta_chi2 desc, r.t0, r.toa_id) - 1 as integer) as rank from r join f on r.toa_id = f.toa_id)
"""
_GREEDY_BACKEND = _GREEDY.format(k=_K, rk=_K, gk="g.series_id, g.grp", join="r.series_id = g.series_id and r.grp = g.grp", vk="r.series_id, r.grp")
EVENTS_SQL = "{rcte}," + _CANDS.format(on=_ON_BACKEND) + _GREEDY_BACKEND + "select series_id, grp, toa_id, round(t0, 6) as t0, round(delta_chi2, 2) as delta_chi2, rank from v"


def transient_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_transients(series_rows(spark, sf_dir), BACKEND, TRANSIENT)
    return out.select("toa_id", "transient_id", ps("transient_amp").alias("transient_amp_ps"), F.round("transient_t0", 6).alias("transient_t0"), F.round("transient_delta_chi2", 2).alias("transient_delta_chi2"))


TRANSIENT_SQL = (
    "{rcte}," + _CANDS.format(on=_ON_BACKEND) + _GREEDY_BACKEND + """,
m as (select s.toa_id, max((v.rank, amp, v.t0, delta_chi2)) as e from s join v on s.series_id = v.series_id and s.grp = v.grp and s.mjd between v.t0 and v.t0 + 35
  where abs(amp) * exp(-(mjd - v.t0) / 7) / sigma >= 1 group by s.toa_id)
select s.toa_id, coalesce(e[1], -1) as transient_id, cast(round(e[2] * 1e12) as bigint) as transient_amp_ps, round(e[3], 6) as transient_t0, round(e[4], 2) as transient_delta_chi2 from s left join m using (toa_id)
"""
)


def global_transient_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_global_transients(series_rows(spark, sf_dir), SERIES, "grp", TRANSIENT)
    p = "transient_global"
    return out.select("toa_id", f"{p}_id", ps(f"{p}_amp").alias(f"{p}_amp_ps"), F.round(f"{p}_t0", 6).alias(f"{p}_t0"), f"{p}_n_members", F.round(f"{p}_z_med", 4).alias(f"{p}_z_med"))


GLOBAL_TRANSIENT_SQL = (
    "{rcte}," + _CANDS.format(on="a.series_id = b.series_id").replace("a.series_id, a.grp,", "a.series_id,")
    + _GREEDY.format(k="series_id", rk="series_id", gk="g.series_id", join="r.series_id = g.series_id", vk="r.series_id")
    + """,
w as (select s.toa_id, s.series_id, s.grp, v.rank, v.t0, resid, sigma, exp(-(mjd - v.t0) / 7) as f from s join v on s.series_id = v.series_id and s.mjd between v.t0 and v.t0 + 35 where sigma is not null),
a as (select series_id, grp, rank, sum(f * resid / (sigma * sigma)) / sum(f * f / (sigma * sigma)) filter (where resid is not null) as amp from w group by all having count(resid) >= 2),
m as (select w.*, amp, abs(amp * f) / sigma as z from w join a using (series_id, grp, rank) where abs(amp * f) / sigma > 1),
n as (select series_id, grp, rank, count(*) as n, median(z) as zm from m group by all),
x as (select toa_id, max((m.rank, amp, t0, n.n, zm)) as e from m join n using (series_id, grp, rank) group by toa_id)
select s.toa_id, coalesce(e[1], -1) as transient_global_id, cast(round(e[2] * 1e12) as bigint) as transient_global_amp_ps, round(e[3], 6) as transient_global_t0,
  coalesce(e[4], 0) as transient_global_n_members, round(e[5], 4) as transient_global_z_med from s left join x using (toa_id)
"""
)


def _fill(sql: str) -> str:
    return sql.replace("{rcte}", CTE.replace("with s as", "with recursive s as", 1)).replace("{cte}", CTE)


QUERIES = {
    f.__name__: f
    for f in (
        robust_mad_group, robust_mad_global, hard_detector, gate, ou_innovations, ou_bad_days, ou_detect, ou_noise, step_scan_group, dm_step_scan_group, step_membership,
        dm_step_membership, global_step_regroup, global_dm_step_regroup, transient_scan_candidates, transient_found, transient_membership, global_transient_regroup,
    )
}
SQL = {
    "robust_mad_group": _MAD.replace("{k}", _K).replace("{p}", "robust"),
    "robust_mad_global": _MAD.replace("{k}", "series_id").replace("{p}", "robust_global"),
    "hard_detector": HARD_SQL,
    "gate": GATE_SQL,
    "ou_innovations": OU_SQL,
    "ou_bad_days": OU_BAD_SQL,
    "ou_noise": NOISE_SQL,
    "step_scan_group": STEP_SQL,
    "dm_step_scan_group": DM_STEP_SQL,
    "step_membership": STEP_MEMBERS_SQL,
    "dm_step_membership": DM_STEP_MEMBERS_SQL,
    "global_step_regroup": GLOBAL_STEP_SQL,
    "global_dm_step_regroup": GLOBAL_DM_STEP_SQL,
    "transient_scan_candidates": CANDS_SQL,
    "transient_found": EVENTS_SQL,
    "transient_membership": TRANSIENT_SQL,
    "global_transient_regroup": GLOBAL_TRANSIENT_SQL,
}
SQL = {k: _fill(v) for k, v in SQL.items()}
