"""Registered queries of the data-preparation problems that live in the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.operators.drift import schema_drift, unified_table
from residua.operators.line_grammar import file_records, loaded_toas, rejected_lines
from residua.operators.salted import Partial, salted_aggregate
from residua.operators.series_faults import find_faults
from residua.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift(table(spark, sf_dir, "frame_dumps"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified_table(table(spark, sf_dir, "frame_dumps"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(table(spark, sf_dir, "tim_lines"), keep=["line_id"]).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid TOA lines as rows of typed columns."""
    return loaded_toas(table(spark, sf_dir, "tim_lines"), keep=["line_id", "_timfile"]).drop("flags")


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per flag of a valid TOA line; the last of equal names holds, and one without a value is 'true'."""
    return loaded_toas(table(spark, sf_dir, "tim_lines"), keep=["line_id"]).select("line_id", F.explode("flags").alias("name", "value"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each file's whole text, where a quoted value may run over line ends: first line, number of lines, kind and reason."""
    return file_records(table(spark, sf_dir, "tim_lines"), file="_timfile", line_no="line_no").select("_timfile", "line_no", "n_lines", "kind", "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_faults(table(spark, sf_dir, "toas"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toas with resid in picoseconds and weight 1/us^2 where both measurements are usable, else null."""
    ok = (F.abs("resid") < 1) & (F.col("sigma") > 0) & (F.col("sigma") < 1)
    return table(spark, sf_dir, "toas").select(
        "toa_id",
        "grp",
        "sys",
        "day",
        F.when(ok, F.col("resid") * 1e12).alias("ps"),
        F.when(ok, F.lit(1e-12) / (F.col("sigma") * F.col("sigma"))).alias("w"),
        F.when(ok, F.abs("resid") / F.col("sigma")).alias("z"),
    )


def _stats(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    aggs = {
        "n": Partial.count(),
        "n_used": Partial.count(F.col("w").isNotNull()),
        "mean": Partial.weighted_mean(F.col("ps"), F.col("w")),
        "z_max": Partial.most(F.col("z")),
    }
    out = salted_aggregate(_weighted(spark, sf_dir), [key], aggs, identity=["toa_id"])
    return out.select(key, "n", "n_used", F.round("mean").cast("bigint").alias("mean_ps"), F.round("z_max", 6).alias("z_max"))


def p5_grp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "grp")


def p5_sys_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, "sys")


def _worst(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    worst = F.struct(F.col("z"), (-F.col("toa_id")).alias("i"))
    aggs = {"n": Partial.count(), "worst": Partial.most(F.when(F.col("z").isNotNull(), worst))}
    # a hot key is hot on all its days; a few salts do, as the days spread it already
    out = salted_aggregate(_weighted(spark, sf_dir), [key, "day"], aggs, identity=["toa_id"], hot_by=[key], salts=4)
    return out.select(key, "day", "n", (-F.col("worst.i")).alias("worst_toa"))


def p5_worst_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per grp and day the row of greatest |resid|/sigma; among equals the least toa_id."""
    return _worst(spark, sf_dir, "grp")


def p5_sys_worst_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per sys and day."""
    return _worst(spark, sf_dir, "sys")


_WEIGHTED = """
with t as (select toa_id, grp, sys, day,
  case when abs(resid) < 1 and sigma > 0 and sigma < 1 then resid * 1e12 end as ps,
  case when abs(resid) < 1 and sigma > 0 and sigma < 1 then 1e-12 / (sigma * sigma) end as w,
  case when abs(resid) < 1 and sigma > 0 and sigma < 1 then abs(resid) / sigma end as z from toas)
"""
_STATS = (
    _WEIGHTED
    + "select {k}, count(*) as n, count(w) as n_used, cast(round(sum(ps * w) / sum(w)) as bigint) as mean_ps, round(max(z), 6) as z_max from t group by {k}"
)
_WORST = _WEIGHTED + "select {k}, day, count(*) as n, arg_min(toa_id, (-z, toa_id)) filter (where z is not null) as worst_toa from t group by {k}, day"

_TOKEN = r'"(?:[^"]|"")*"|[^\s"]+'
_NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?(?:[eEdD][+-]?\d+)?|[+-]?\.\d+(?:[eEdD][+-]?\d+)?"
_LINES = rf"""
with t as (select line_id, _timfile, line_no, line, regexp_full_match(line, '\s*(?:(?:{_TOKEN})(?:\s+(?:{_TOKEN}))*)?\s*') as clean, regexp_extract_all(line, '{_TOKEN}') as k,
    regexp_extract(line, '^\s*(\S*)', 1) as head from tim_lines),
c as (select * from t where head not in ('', 'C', '#', 'MODE', 'FORMAT', 'EFAC', 'EQUAD', 'JUMP')),
v as (select *, list_transform(k, lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as u from c),
n as (select *, list_transform(u, lambda x: case when regexp_full_match(x, '{_NUMBER}') then try_cast(regexp_replace(replace(x, ',', ''), '[dD]', 'e') as double) end) as w from v),
f as (select *, list_transform(range(1, len(k) + 1), lambda i: k[i][1] = '-' and (w[i] is null or isinf(w[i]))) as g, case when isfinite(w[1]) then 1 else 0 end as s from n),
h as (select *, coalesce(list_position(g, true), len(k) + 1) - 1 as m, upper(k[1]) in ('TIME', 'INCLUDE') as d from f),
r as (select *, case when not clean then 'quoting'
  when d then case when len(k) <> 2 then 'columns' when upper(k[1]) = 'TIME' and not coalesce(isfinite(w[2]), false) then 'value' end
  when m <> 5 + s or len(list_filter(range(m + 2, len(k) + 1), lambda i: not g[i] and not g[i - 1])) > 0 then 'columns'
  when not coalesce(w[2 + s] > 0 and w[2 + s] <= 100000 and w[3 + s] between 40000 and 70000 and w[4 + s] > 0 and w[4 + s] <= 10000 and (s = 0 or w[1] between 40000 and 70000), false) then 'value' end as reason from h)
"""
P3_SQL = _LINES + "select line_id, reason from r where reason is not null"
P3_LOADED_SQL = (
    _LINES
    + "select line_id, _timfile, case when s = 1 then w[1] end as sat, u[1 + s] as filename, w[2 + s] as freq, w[3 + s] as mjd, w[4 + s] as toaerr, u[5 + s] as tel from r where reason is null and not d"
)
P3_FLAGS_SQL = (
    _LINES
    + """, p as (select line_id, g, u, unnest(range(m + 1, len(k) + 1)) as i from r where reason is null and not d),
q as (select line_id, u[i][2:] as name, case when i < len(u) and not g[i + 1] then u[i + 1] else 'true' end as value, i from p where g[i])
select line_id, name, arg_max(value, i) as value from q group by line_id, name"""
)
#: no quoted value of the tables runs over a line end, so every line is a record there
P3_RECORDS_SQL = (
    _LINES
    + """select _timfile, line_no, cast(1 as integer) as n_lines, case when reason is not null then 'error' when head = '' then 'blank' when head in ('C', '#') then 'comment'
  when head in ('MODE', 'FORMAT', 'EFAC', 'EQUAD', 'JUMP') then 'control' when d then lower(head) else 'toa' end as kind, reason
from t left join (select line_id, reason, d from r) e using (line_id)"""
)
P4_SQL = """
with u as (select toa_id, psr, grp, mjd, resid, sigma, coalesce(not abs(resid) < 1, false) or coalesce(not (sigma > 0 and sigma < 1), false) or coalesce(not (mjd between 40000 and 70000), false) as wild from toas),
r as (select * from u where not wild and mjd is not null and resid is not null and grp is not null and not upper(grp) like 'UNK%'),
g as (select *, case when resid = lag(resid) over (partition by psr, grp order by mjd, toa_id) then 0 else 1 end as fresh from r),
h as (select *, sum(fresh) over (partition by psr, grp order by mjd, toa_id rows unbounded preceding) as run from g),
k as (select *, count(*) over (partition by psr, grp, run) as c from h),
l as (select *, abs(resid - median(resid) over (partition by psr, grp order by mjd, toa_id rows between 15 preceding and 15 following)) as e from k where c < 6),
m as (select *, 1.4826 * median(e) over (partition by psr, grp) as s from l)
select toa_id, 'impossible' as kind from u where wild union all select toa_id, 'stuck' from k where c >= 6 union all select toa_id, 'spike' from m where e > 9 * s and e > 9 * sigma
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_unified, p3_found, p3_loaded, p3_flags, p3_records, p4_found, p5_worst_of_day, p5_sys_worst_of_day, p5_grp_stats, p5_sys_stats)}
SQL: dict[str, str] = {
    "p3_found": P3_SQL,
    "p3_loaded": P3_LOADED_SQL,
    "p3_flags": P3_FLAGS_SQL,
    "p3_records": P3_RECORDS_SQL,
    "p4_found": P4_SQL,
    "p5_grp_stats": _STATS.format(k="grp"),
    "p5_sys_stats": _STATS.format(k="sys"),
    "p5_worst_of_day": _WORST.format(k="grp"),
    "p5_sys_worst_of_day": _WORST.format(k="sys"),
}
