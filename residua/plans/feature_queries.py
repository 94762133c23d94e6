"""Registered queries of joins, keys, covariates, binned models and parsing, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.options import options
from residua.functions.stats import erfc_sql, folded_distance, year_of_mjd
from residua.operators.asof import merge_time_and_meta, nearest_asof
from residua.operators.binned import detrend, orbital_cut, rescale, structure_test, with_orbital_cut
from residua.operators.features import freq_bins, orbital_phase
from residua.operators.keys import ensure_sys_group, file_triplet
from residua.plans.detector_queries import BACKEND, CTE, SERIES, ps
from residua.sources.tables import series_rows, table
from residua.sources.tim import permissive_records

TOL = options("merge").tolerance_days


def _asof(spark: SparkSession, sf_dir: str, right_on, by: dict) -> DataFrame:
    keys = {"psr": (F.col("psr"), F.col("psr")), **by}
    return nearest_asof(table(spark, sf_dir, "toas"), table(spark, sf_dir, "tim_meta"), left_id="toa_id", right_id="meta_id", left_on="mjd", right_on=right_on, tolerance=TOL, by=keys)


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, F.coalesce("sat_corr", "mjd"), {})


def asof_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.when(F.abs("freq") < 1e9, F.rint("freq"))
    return _asof(spark, sf_dir, F.coalesce("sat_corr", "mjd"), {"bin": (usable, usable)})


def merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: corrected time, per frequency bin, plain mjd."""
    toas = table(spark, sf_dir, "toas").withColumn("freq", F.when(F.abs("freq") < 1e9, F.col("freq")))
    out = merge_time_and_meta(toas, table(spark, sf_dir, "tim_meta"))
    return out.select("toa_id", "meta_id", "_timfile", "filename", F.col("freq_meta"))


_ASOF = """
u{n} as (select psr{bc}, {k} as k, null::bigint as l, {id} as r, 0 as side from {right} where {k} is not null {rw}
  union all select psr{bc}, mjd, toa_id, null, 1 from {left} where mjd is not null and not isnan(mjd) {lw}),
b{n} as (select *, last_value(case when side = 0 then k end ignore nulls) over w1 as bk, last_value(r ignore nulls) over w1 as br,
  last_value(case when side = 0 then k end ignore nulls) over w2 as fk, last_value(r ignore nulls) over w2 as fr from u{n}
  window w1 as (partition by psr{bc} order by k, side, r rows between unbounded preceding and current row),
         w2 as (partition by psr{bc} order by k desc, side, r desc rows between unbounded preceding and current row)),
m{n} as (select l as toa_id, case when k - bk <= {t} and (fk is null or fk - k > {t} or k - bk <= fk - k) then br when fk - k <= {t} then fr end as meta_id from b{n} where side = 1),
f{n} as (select * from m{n} where meta_id is not null)
"""
_T = "(2e0/86400e0)"
ASOF_SQL = "with" + _ASOF.format(n=1, bc="", k="coalesce(sat_corr, mjd)", id="meta_id", right="tim_meta", left="toas", rw="", lw="", t=_T) + "select * from f1"
_BIN = "psr, case when abs(freq) < 1e9 then round_even(freq, 0) end as bin, mjd"
ASOF_BY_SQL = (
    f"with ta as (select toa_id, {_BIN} from toas), tb as (select meta_id, sat_corr, {_BIN} from tim_meta),"
    + _ASOF.format(n=1, bc=", bin", k="coalesce(sat_corr, mjd)", id="meta_id", right="tb", left="ta", rw="and bin is not null", lw="and bin is not null", t=_T)
    + "select * from f1"
)
MERGE_SQL = (
    f"with ta as (select toa_id, {_BIN} from toas), tb as (select meta_id, sat_corr, {_BIN} from tim_meta),"
    + _ASOF.format(n=1, bc="", k="coalesce(sat_corr, mjd)", id="meta_id", right="tb", left="ta", rw="", lw="", t=_T)
    + ", r1 as (select * from ta where toa_id not in (select toa_id from f1)),"
    + _ASOF.format(n=2, bc=", bin", k="coalesce(sat_corr, mjd)", id="meta_id", right="tb", left="r1", rw="and bin is not null", lw="and bin is not null", t=_T)
    + ", r2 as (select * from r1 where toa_id not in (select toa_id from f2)),"
    + _ASOF.format(n=3, bc="", k="mjd", id="meta_id", right="tb", left="r2", rw="", lw="", t=_T)
    + """, a as (select * from f1 union all select * from f2 union all select * from f3)
select t.toa_id, a.meta_id, m._timfile, m.filename, m.freq as freq_meta from toas t left join a using (toa_id) left join tim_meta m on a.meta_id = m.meta_id"""
)


def triplet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = file_triplet(F.col("_timfile"))
    return table(spark, sf_dir, "tim_meta").select("_timfile").distinct().select("_timfile", t["tel"].alias("tel"), t["backend"].alias("backend"), t["band"].alias("band"))


_TRIPLET = """
  regexp_replace(trim(regexp_extract({p}, '([^/]*)$', 1)), '\\.tim$', '') as nm, string_split(nm, '.') as pt,
  not lower(trim(regexp_extract({p}, '([^/]*)$', 1))) like '%\\_all.tim' escape '\\' and upper(pt[1]) in ('EFF','JBO','NRT','WSRT','SRT','LEAP') as ok,
  case when ok then upper(pt[1]) end as tel,
  case when ok then case when len(pt) = 2 then case when try_cast(pt[2] as double) is null then pt[2] end else pt[2] end end as backend,
  case when ok then case when len(pt) = 2 then try_cast(pt[2] as double) else try_cast(pt[3] as double) end end as band
"""
TRIPLET_SQL = f"with d as (select distinct _timfile from tim_meta), x as (select _timfile, {_TRIPLET.format(p='_timfile')} from d) select _timfile, tel, backend, band from x"


def sys_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_sys_group(table(spark, sf_dir, "tim_meta")).select("meta_id", "sys", "grp")


KEYS_SQL = f"""
with md as (select _timfile as tf, median(freq) as mf, median(cenfreq) as mc from tim_meta group by 1),
f as (select *, coalesce(nullif(_timfile_base, ''), _timfile) as guess from tim_meta),
x as (select meta_id, freq, cenfreq, be, sys, grp, _timfile, {_TRIPLET.format(p="guess")} from f),
y as (select *, coalesce(tel, case when contains(sys, '.') then string_split(sys, '.')[1] end, case when contains(grp, '.') then string_split(grp, '.')[1] end, 'UNK') as t,
  upper(coalesce(backend, be, 'UNK')) as b, cast(cast(round_even(freq, 0) as bigint) as varchar) as ch,
  cast(cast(round_even(coalesce(cenfreq, band, mc, mf, freq), 0) as bigint) as varchar) as bd from x join md on md.tf = _timfile)
select meta_id, case when sys is null or upper(sys) like 'UNK%' then t || '.' || b || '.' || coalesce(ch, 'UNK') else sys end as sys,
  case when grp is null or upper(grp) like 'UNK%' then t || '.' || b || '.' || coalesce(bd, 'UNK') else grp end as grp from y
"""


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, phase of a fixed orbit, year and folded phase distance."""
    return series_rows(spark, sf_dir).select(
        "toa_id", F.floor("mjd").alias("day_key"), F.round(orbital_phase(F.col("mjd"), 67.825, 50000.5), 6).alias("phase"), year_of_mjd(F.col("mjd")).alias("year"),
        F.round(folded_distance(F.col("orbital_phase"), 0.25), 6).alias("distance"),
    )


PROJECTION_SQL = CTE + """
select toa_id, cast(floor(mjd) as bigint) as day_key, round((mjd - 50000.5) / 67.825 - floor((mjd - 50000.5) / 67.825), 6) as phase,
 cast(trunc(2000 + (mjd - 51544.5) / 365.25) as integer) as year, round(least(abs(orbital_phase - 0.25), 1 - abs(orbital_phase - 0.25)), 6) as distance from s"""


def freq_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq_bins(series_rows(spark, sf_dir), SERIES).select("toa_id", "freq_bin")


_EDGES = "list_transform(range(0, {nb} + 1), lambda i: case when i = {nb} then hi else i * ((hi - lo) / {nb}) + lo end)"
FREQ_BIN_SQL = CTE + f""", r as (select *, min(freq) over w as lo, max(freq) over w as hi from s window w as (partition by series_id))
select toa_id, cast(case when lo is null then null when lo = hi then 0 when freq is null then 7 else greatest(0, least(len(list_filter({_EDGES.format(nb=8)}, lambda e: e <= freq)) - 1, 7)) end as integer) as freq_bin from r"""


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_rows(spark, sf_dir)
    parts = [structure_test(rows, BACKEND, f).withColumn("feature", F.lit(f)) for f in options("structure").test]
    return parts[0].unionByName(parts[1]).select(*BACKEND, "feature", F.round("chi2", 3).alias("chi2"), F.col("dof").cast("bigint").alias("dof"), F.round("p", 6).alias("p"), "present")


def _binned_sql(feature: str, circular: bool, k: str, nmin: int, n: str = "", y: str = "resid", src: str = "s") -> str:
    x = f"({feature} - floor({feature}))" if circular else feature
    lo, hi = ("0e0", "1e0") if circular else ("min(gx) over g", "max(gx) over g")
    nb = f"cast(case when lo = hi then 1 else least(12, greatest(3, n // {nmin})) end as bigint)"
    return f"""
x{n} as (select *, {x} as x, case when {y} is not null and sigma is not null then {x} end as gx from {src}),
g{n} as (select *, case when count(gx) over g > 0 then {lo} end as lo, case when count(gx) over g > 0 then {hi} end as hi, count(gx) over g as n from x{n} window g as (partition by {k})),
e{n} as (select *, {nb} as nb from g{n}),
t{n} as (select *, case when x is not null and n > 0 then greatest(0, least(len(list_filter({_EDGES.format(nb="nb")}, lambda e: e <= x)) - 1, nb - 1)) end as bin from e{n}),
m{n} as (select {k}, bin, count(*) as c, sum({y} / (sigma * sigma)) / sum(1 / (sigma * sigma)) as mean, sum(1 / (sigma * sigma)) as w from t{n} where bin is not null and gx is not null group by all having count(*) >= {nmin})"""


def _tail_sql() -> str:
    z = "((cbrt(chi2 / dof) - (1 - 2 / (9e0 * dof))) / sqrt(2 / (9e0 * dof)))"
    half = erfc_sql(f"abs({z}) / sqrt(2e0)") + " / 2"
    return f"case when {z} >= 0 then {half} else 1 - {half} end"


STRUCTURE_SQL = (
    CTE + "," + _binned_sql("solar_elongation_deg", False, "series_id, grp", 3, "1") + "," + _binned_sql("orbital_phase", True, "series_id, grp", 3, "2")
    + f""", c as (select series_id, grp, 'solar_elongation_deg' as feature, sum(mean * mean * w) as chi2, count(*) as dof from m1 group by all
  union all select series_id, grp, 'orbital_phase', sum(mean * mean * w), count(*) from m2 group by all),
p as (select *, {_tail_sql()} as p from c)
select series_id, grp, feature, round(chi2, 3) as chi2, dof, round(p, 6) as p, p < 0.01 as present from p"""
)


def structure_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = detrend(series_rows(spark, sf_dir), BACKEND, ("solar_elongation_deg", "orbital_phase"), out="resid_detrended", min_per_bin=3)
    return out.select("toa_id", ps("resid_detrended").alias("resid_ps"))


STRUCTURE_DETREND_SQL = (
    CTE + "," + _binned_sql("solar_elongation_deg", False, "series_id, grp", 3, "1")
    + ", v as (select toa_id, t1.series_id, t1.grp, sigma, orbital_phase, resid - coalesce(mean, 0) as r from t1 left join m1 on t1.series_id = m1.series_id and t1.grp = m1.grp and t1.bin = m1.bin),"
    + _binned_sql("orbital_phase", True, "series_id, grp", 3, "2", y="r", src="v")
    + " select toa_id, cast(round((r - coalesce(mean, 0)) * 1e12) as bigint) as resid_ps from t2 left join m2 on t2.series_id = m2.series_id and t2.grp = m2.grp and t2.bin = m2.bin"
)


def preproc_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model: mean of each populated bin."""
    _, models = detrend(series_rows(spark, sf_dir), BACKEND, ("orbital_phase",), min_per_bin=5)
    return models.select("feature", *BACKEND, F.col("bin").cast("bigint").alias("bin"), "n", ps("mean").alias("mean_ps"), F.round("edge_lo", 6).alias("edge_lo"))


PREPROC_SQL = CTE + "," + _binned_sql("orbital_phase", True, "series_id, grp", 5, "1") + """, nb as (select distinct series_id, grp, nb from t1 where nb is not null)
 select 'orbital_phase' as feature, m1.series_id, m1.grp, bin, c as n, cast(round(mean * 1e12) as bigint) as mean_ps, round(bin * (1e0 / nb), 6) as edge_lo from m1 join nb on m1.series_id = nb.series_id and m1.grp = nb.grp"""


def preproc_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rescale(series_rows(spark, sf_dir), BACKEND, "solar_elongation_deg")
    return out.select("toa_id", F.round(F.col("resid_proc") * 1e4).cast("bigint").alias("resid_proc_e4"), F.round("sigma_proc", 4).alias("sigma_proc"))


RESCALE_SQL = CTE + "," + _binned_sql("solar_elongation_deg", False, "series_id, grp", 5, "1") + """,
d as (select *, case when bin is not null then median(case when gx is not null then resid end) over (partition by series_id, grp, bin) end as med from t1),
a as (select *, case when bin is not null then median(case when gx is not null then abs(resid - med) end) over (partition by series_id, grp, bin) end as mad, count(gx) over (partition by series_id, grp, bin) as c from d),
f as (select *, case when bin is not null and c >= 5 and mad > 0 then 1.4826 * mad else 1 end as sc from a)
select toa_id, cast(round(resid / sc * 1e4) as bigint) as resid_proc_e4, round(sigma / sc, 4) as sigma_proc from f"""


def orbital_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = options("orbital", on=True, sigmas=5.0)
    out = orbital_cut(series_rows(spark, sf_dir), SERIES, cfg)
    return out.select("series_id", F.round("orbital_cut_phase", 6).alias("orbital_cut_phase"))


_CUT = """,
d as (select *, least(abs(orbital_phase - 0.25), 1 - abs(orbital_phase - 0.25)) as d, abs(resid) / sigma as z from s where orbital_phase is not null and resid is not null and sigma is not null),
e as (select *, len(list_filter(list_transform(range(0, 19), lambda i: case when i = 18 then 0.5 else i * (0.5 / 18) end), lambda e: e <= d)) - 1 as bin from d),
n as (select series_id from e group by 1 having count(*) >= 20),
m as (select series_id, bin, median(z) as med, 0.5 * (bin * (0.5 / 18) + case when bin = 17 then 0.5 else (bin + 1) * (0.5 / 18) end) as c from e where bin < 18 group by all),
t as (select *, max(med) over (partition by series_id order by bin rows between current row and unbounded following) as tail from m),
k as (select series_id, coalesce(min(c) filter (where tail <= 5), avg(c) filter (where med <= 5)) as cut from t where series_id in (select series_id from n) group by 1)
"""
CUT_SQL = CTE + _CUT + "select series_id, round(cut, 6) as orbital_cut_phase from k"


def orbital_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_orbital_cut(series_rows(spark, sf_dir), SERIES, options("orbital", on=True, sigmas=5.0))
    return out.select("toa_id", "orbital_phase_bad")


ORBITAL_BAD_SQL = CTE + _CUT + "select toa_id, coalesce(least(abs(orbital_phase - 0.25), 1 - abs(orbital_phase - 0.25)) <= cut, false) as orbital_phase_bad from s left join k using (series_id)"


def tim_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permissive reader over all lines."""
    out = permissive_records(table(spark, sf_dir, "tim_lines"))
    return out.select("line_id", "kind", "filename", "freq", "mjd", "toaerr_tim", "tel", F.round("_time_offset_sec", 6).alias("offset_sec"), F.size(F.coalesce("flags", F.create_map().cast("map<string,string>"))).alias("n_flags"))


_NUM = r"^[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eEdD][+-]?[0-9]+)?$"
_TIM = rf"""
with k as (select line_id, _timfile, line_no, list_filter(regexp_split_to_array(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda x: x <> '') as t from tim_lines),
n as (select *, list_transform(t, lambda x: case when regexp_matches(x, '{_NUM}') then try_cast(regexp_replace(replace(x, ',', ''), '[dD]', 'e') as double) end) as v, len(t) as z from k),
a as (select *, case when z < 4 then null when z >= 5 and v[1] is not null and v[3] is not null and v[4] is not null and v[5] is not null then 3
  when v[2] is not null and v[3] is not null and v[4] is not null then 2
  else list_filter(range(2, greatest(z - 1, 3)), lambda i: v[i] is not null and v[i + 1] is not null and v[i + 2] is not null)[1] end as p from n),
c as (select *, case when z = 0 then 'blank' when t[1] in ('C', '#') then 'comment' when t[1] in ('MODE', 'FORMAT', 'EFAC', 'EQUAD', 'JUMP') then 'control'
  when upper(t[1]) = 'TIME' then case when v[2] is not null then 'time' else 'dropped' end when upper(t[1]) = 'INCLUDE' then case when z >= 2 then 'include' else 'dropped' end
  when p is not null then 'toa' else 'dropped' end as kind from a),
o as (select *, sum(case when kind = 'time' then v[2] else 0 end) over (partition by _timfile order by line_no rows unbounded preceding) as off,
  list_filter(range(1, z + 1), lambda i: i >= p + 3 and t[i][1] = '-' and v[i] is null) as fl from c)
"""
TIM_SQL = _TIM + """
select line_id, kind, case when kind = 'toa' then t[p - 1] end as filename, case when kind = 'toa' then v[p] end as freq, case when kind = 'toa' then v[p + 1] end as mjd,
  case when kind = 'toa' then v[p + 2] end as toaerr_tim, case when kind = 'toa' and not (t[p + 3][1] = '-' and v[p + 3] is null) then t[p + 3] end as tel, round(off, 6) as offset_sec,
  cast(case when kind = 'toa' then len(list_distinct(list_transform(fl, lambda i: t[i]))) else 0 end as integer) as n_flags from o
"""


def tim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per flag of a TOA line of the permissive reader: the last of equal names holds, one without a value is 'true'."""
    out = permissive_records(table(spark, sf_dir, "tim_lines")).where("kind = 'toa'")
    # explode_outer: a filter on the flags' number would be pushed down as one expression of all steps
    return out.select("line_id", F.explode_outer("flags").alias("name", "value")).where("name is not null")


TIM_FLAGS_SQL = _TIM + """,
f as (select line_id, t, v, z, unnest(fl) as i from o where kind = 'toa'),
g as (select line_id, i, t[i][2:] as name, case when i = z or (t[i + 1][1] = '-' and v[i + 1] is null) then 'true' else t[i + 1] end as value from f)
select line_id, name, arg_max(value, i) as value from g group by line_id, name"""


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre frequency and bandwidth of each line's flags as numbers, backend, system and group as text."""
    flags = F.col("flags")
    out = permissive_records(table(spark, sf_dir, "tim_lines")).where("kind = 'toa'")
    return out.select("line_id", *[flags[c].try_cast("double").alias(c) for c in ("cenfreq", "bw")], *[flags[c].alias(c) for c in ("be", "sys")], flags["group"].alias("grp"))


COERCED_SQL = f"""with fl as ({TIM_FLAGS_SQL}), toa as (select line_id from ({TIM_SQL}) x where kind = 'toa')
select line_id, max(try_cast(value as double)) filter (where name = 'cenfreq') as cenfreq, max(try_cast(value as double)) filter (where name = 'bw') as bw,
  max(value) filter (where name = 'be') as be, max(value) filter (where name = 'sys') as sys, max(value) filter (where name = 'group') as grp from toa left join fl using (line_id) group by line_id"""

QUERIES = {
    f.__name__: f
    for f in (
        asof_nearest, asof_by_key, merge_meta, triplet_parse, sys_group_keys, projections, freq_bin, structure, structure_detrend, preproc_detrend,
        preproc_rescale, orbital_cuts, orbital_bad, tim_parse, tim_flags, coerced,
    )
}
SQL = {
    "asof_nearest": ASOF_SQL, "asof_by_key": ASOF_BY_SQL, "merge_meta": MERGE_SQL, "triplet_parse": TRIPLET_SQL, "sys_group_keys": KEYS_SQL,
    "projections": PROJECTION_SQL, "freq_bin": FREQ_BIN_SQL, "structure": STRUCTURE_SQL, "structure_detrend": STRUCTURE_DETREND_SQL,
    "preproc_detrend": PREPROC_SQL, "preproc_rescale": RESCALE_SQL, "orbital_cuts": CUT_SQL, "orbital_bad": ORBITAL_BAD_SQL, "tim_parse": TIM_SQL,
    "tim_flags": TIM_FLAGS_SQL, "coerced": COERCED_SQL,
}
