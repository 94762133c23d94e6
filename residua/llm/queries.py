"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.leakage import leak_spans, without_leaks
from residua.llm.nearest_time import attach_nearest, nearest_matches
from residua.llm.packing import CAPACITIES, pack_documents, token_counts
from residua.llm.quantiles import combine, group_percentiles, percentiles, summarise
from residua.llm.stuffing import spam_shares
from residua.session import checkpointed
from residua.sources.tables import table

TOLERANCE_DAYS = 2.0 / 86400
CHANNEL_MHZ = 1.0
EPS = 0.005


def _nearest() -> dict:
    return dict(
        left_id="toa_id", right_id="meta_id", entity="psr", left_time="mjd", right_time=F.coalesce("sat_corr", "mjd"), left_channel="freq", right_channel="freq",
        tolerance=TOLERANCE_DAYS, channel_tolerance=CHANNEL_MHZ,
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_matches(table(spark, sf_dir, "toas"), table(spark, sf_dir, "tim_meta"), **_nearest()).select("toa_id", "meta_id")


def p1_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timing row with the file and corrected time of its record."""
    out = attach_nearest(table(spark, sf_dir, "toas"), table(spark, sf_dir, "tim_meta"), **_nearest())
    return out.select("toa_id", "meta_id", "_timfile", "sat_corr")


P1_SQL = """
with l as (select toa_id, psr, mjd, freq from toas where isfinite(mjd) and isfinite(freq)),
     r as (select meta_id, psr, coalesce(sat_corr, mjd) as t, freq from tim_meta where isfinite(coalesce(sat_corr, mjd)) and isfinite(freq)),
     lk as (select *, unnest([floor(mjd * 1000) - 1, floor(mjd * 1000), floor(mjd * 1000) + 1]) as k from l),
     rk as (select *, floor(t * 1000) as k from r)
select toa_id, arg_min(meta_id, (abs(mjd - t), meta_id)) as meta_id
from lk join rk on lk.psr = rk.psr and lk.k = rk.k
where abs(lk.freq - rk.freq) <= 1.0 and abs(mjd - t) <= 2.0::double / 86400
group by toa_id
"""

def p6_resid_by_grp_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per grp the percentiles of each day and, with a null day, of the whole: the days' summaries combined."""
    days = checkpointed(summarise(table(spark, sf_dir, "toas"), ["grp", "day"], "resid", eps=EPS))
    whole = combine(days, ["grp"], eps=EPS).withColumn("day", F.lit(None).cast("bigint"))
    return percentiles(days.unionByName(whole), ["grp", "day"])


def p6_freq_by_timfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_percentiles(table(spark, sf_dir, "tim_meta"), ["_timfile"], "freq", eps=EPS)


def p6_resid_by_grp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_percentiles(table(spark, sf_dir, "toas"), ["grp"], "resid", eps=EPS)


def p6_resid_by_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of each month of loading, combined into the whole."""
    toas = table(spark, sf_dir, "toas").withColumn("load_month", F.date_trunc("month", "loaded_at"))
    return percentiles(combine(summarise(toas, ["grp", "load_month"], "resid", eps=EPS), ["grp"], eps=EPS), ["grp"])


def p6_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per grp, whether each percentile of resid holds its bound against the exact ranks, and the bound holds EPS."""
    got = p6_resid_by_grp(spark, sf_dir)
    names = [c for c in got.columns if c not in ("grp", "n", "rank_error")]
    rows = table(spark, sf_dir, "toas").where(F.abs("resid") < float("inf")).select(F.col("grp").alias("_g"), "resid")
    # one row per grp on one side; both ranks of every percentile by map-side sums
    at = rows.join(got, F.col("_g").eqNullSafe(F.col("grp")))
    ranks = at.groupBy("grp", "n", "rank_error", *names).agg(
        *[F.count_if(F.col("resid") < F.col(c)).alias(f"_l_{c}") for c in names], *[F.count_if(F.col("resid") <= F.col(c)).alias(f"_u_{c}") for c in names]
    )
    within = F.col("rank_error") <= EPS
    for c in names:
        want = 1 + F.floor((F.col("n") - 1) * F.lit(float(c[1:].replace("_", ".")) / 100) + 0.5)
        off = F.greatest(F.col(f"_l_{c}") + 1 - want, want - F.col(f"_u_{c}"), F.lit(0))
        within = within & (off <= F.col("rank_error") * F.col("n") + 1e-6)
    return ranks.select("grp", "n", within.alias("within"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed with all their tokens, those cut without need, bins beyond their capacity, capacities opened."""
    docs = table(spark, sf_dir, "documents")
    pieces = checkpointed(pack_documents(docs))
    top = max(CAPACITIES)
    of_doc = pieces.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"), F.countDistinct("start").alias("starts"))
    counted = token_counts(docs).withColumnRenamed("n_tokens", "tokens")
    doc = of_doc.join(counted, "doc_id", "full").agg(
        F.count_if(F.col("n") == F.col("tokens")).alias("n_whole"),
        F.count_if(F.coalesce(F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / top)), F.lit(True)) | (F.col("starts") != F.col("k"))).alias("n_cut_amiss"),
    )
    bins = pieces.groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.max("bin_capacity").alias("cap"), F.count("*").alias("k"))
    over = bins.agg(F.count_if((F.col("used") > F.col("cap")) | (F.col("cap") > top)).alias("n_over"))
    return doc.crossJoin(over)  # two single rows


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item and document the first shared word, the number of shared stretches and of words in them, and the document's words."""
    first = F.col("spans")[0]["from"].alias("first_word")
    return _leaks(spark, sf_dir).select("item_id", "doc_id", first, F.size("spans").cast("bigint").alias("n_spans"), "n_shared", "n_words")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with leaked passages cut out, without those of which more than half leaked."""
    return without_leaks(table(spark, sf_dir, "documents"), checkpointed(_leaks(spark, sf_dir))).select("doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_shares(table(spark, sf_dir, "documents"), above=0.5).select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_shares(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_attached, p6_resid_by_grp_day, p6_freq_by_timfile, p6_resid_by_grp, p6_resid_by_load, p6_bounds, p7_packed, p7_whole, p8_found, p8_spans, p8_cleaned,
        p9_found, p9_shares,
    )
}
P1_ATTACHED_SQL = f"select toa_id, meta_id, _timfile, sat_corr from toas left join ({P1_SQL}) m using (toa_id) left join (select meta_id, _timfile, sat_corr from tim_meta) r using (meta_id)"
P6_BOUNDS_SQL = "select grp, count(*) as n, true as within from toas where isfinite(resid) group by grp"
P7_WHOLE_SQL = "select count(*) as n_whole, cast(0 as bigint) as n_cut_amiss, cast(0 as bigint) as n_over from documents"
_GRAMS = r"""
with d as (select doc_id, regexp_extract_all(regexp_replace(lower(text), '-\r?\n', '', 'g'), '[\p{L}\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(regexp_replace(lower(passage), '-\r?\n', '', 'g'), '[\p{L}\p{N}]+') as w from eval_items),
dw as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as k from d),
iw as (select item_id, unnest(w) as t, generate_subscripts(w, 1) as k from i),
known as (select doc_id, t, k from dw where t in (select t from iw)),
dg as (select doc_id, string_agg(t, ' ') over n as g, k, max(k) over n as last from known window n as (partition by doc_id order by k rows between current row and 12 following)),
ig as (select item_id, string_agg(t, ' ') over n as g, k, max(k) over n as last from iw window n as (partition by item_id order by k rows between current row and 12 following))"""
P8_SQL = _GRAMS + " select distinct item_id, doc_id from (select * from ig where last = k + 12) i join (select * from dg where last = k + 12) d using (g)"
P8_SPANS_SQL = _GRAMS + """,
m as (select distinct item_id, doc_id, d.k from (select * from ig where last = k + 12) i join (select * from dg where last = k + 12) d using (g)),
p as (select *, k - lag(k) over (partition by item_id, doc_id order by k) as gap from m)
select item_id, doc_id, cast(min(k) - 1 as integer) as first_word, count(*) filter (where gap is null or gap > 13) as n_spans,
  cast(sum(case when gap is null or gap > 13 then 13 else gap end) as bigint) as n_shared, cast(any_value(len(w)) as bigint) as n_words from p join d using (doc_id) group by item_id, doc_id
"""

SQL = {"p1_found": P1_SQL, "p1_attached": P1_ATTACHED_SQL, "p6_bounds": P6_BOUNDS_SQL, "p7_whole": P7_WHOLE_SQL, "p8_found": P8_SQL, "p8_spans": P8_SPANS_SQL}
