"""Where timing rows come from: any table with the columns of the series."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: columns of a series row
COLUMNS = ("toa_id", "mjd", "resid", "sigma", "freq")


class TimingSource(Protocol):
    def rows(self, spark: SparkSession) -> DataFrame: ...


class FrameSource:
    """A DataFrame that is there already."""

    def __init__(self, df: DataFrame):
        self.df = df

    def rows(self, spark: SparkSession) -> DataFrame:
        return clean_rows(self.df)


class FileSource:
    """Parquet, ORC, CSV (with header) or JSON lines, by the format's name or the path's ending."""

    def __init__(self, path: str, fmt: str | None = None):
        self.path, self.fmt = path, fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()

    def rows(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("header", True) if self.fmt == "csv" else spark.read
        return clean_rows(reader.format(self.fmt).load(self.path))


def clean_rows(df: DataFrame) -> DataFrame:
    """Doubles with NaN and infinities as null, a row id and the day; sigma given in microseconds (sigma_us) becomes seconds."""
    out = df
    if "sigma" not in out.columns and "sigma_us" in out.columns:
        out = out.withColumn("sigma", F.col("sigma_us").try_cast("double") * 1e-6)
    for c in ("mjd", "resid", "sigma", "freq", "orbital_phase", "solar_elongation_deg"):
        if c in out.columns:
            v = F.col(c).try_cast("double")
            out = out.withColumn(c, F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v))
    if "toa_id" not in out.columns:
        order = [c for c in ("mjd", "freq", "resid", "sigma") if c in out.columns]
        out = out.withColumn("toa_id", F.xxhash64(*order, F.monotonically_increasing_id()))
    missing = [c for c in COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out.withColumn("day", F.floor("mjd"))


def write_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result sink; CSV gets a header, nested columns as JSON."""
    if fmt == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
