"""Test tables and the series views made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: every timing row as a row of a series, with unusable values as null, in SQL that Spark and other engines read alike;
#: operators and queries leave out only the rows that lack what they read
SERIES_SQL = """
select toa_id, psr as series_id, case when grp is null or upper(grp) like 'UNK%' then 'UNK' else grp end as grp, case when mjd between 40000 and 70000 then mjd end as mjd,
  cast(floor(case when mjd between 40000 and 70000 then mjd end) as bigint) as day, case when freq > 0 and freq <= 100000 then freq end as freq,
  case when sigma > 0 and sigma < 1 then sigma end as sigma, case when abs(resid) < 1 then resid end as resid,
  case when orbital_phase between 0 and 1 then orbital_phase end as orbital_phase, solar_elongation_deg from {toas}
"""


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toas as one series per pulsar, groups within it."""
    return spark.sql(SERIES_SQL.format(toas="{src}"), src=table(spark, sf_dir, "toas"))
