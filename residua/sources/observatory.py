"""Observatory positions: white-space files of x y z NAME [aliases ... code]."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- fixed values: geocentric positions in metres by name and code ------------
SITES = {
    "gbt": (882589.289, -4924872.368, 3943729.418),
    "arecibo ao": (2390487.080, -5564731.357, 1994720.633),
    "parkes pks": (-4554231.5, 2816759.1, -3454036.3),
    "srt": (4865182.7660, 791922.6890, 4035137.1740),
    "vla": (-1601192.0, -5041981.4, 3554871.4),
    "nancay ncy nrt": (4324165.81, 165927.11, 4670132.83),
    "effelsberg eff": (4033949.5, 486989.4, 4900430.8),
    "leap": (4033949.5, 486989.4, 4900430.8),
    "wsrt": (3828445.659, 445223.600000, 5064921.5677),
    "lofar": (3826577.462, 461022.624, 5064892.526),
    "gmrt": (1656342.30, 5797947.77, 2073243.16),
    "fast": (-1668557.2, 5506838.5, 2744934.9),
    "meerkat": (5109360.133, 2006852.586, -3238948.127),
    "jodrell jb jbo": (3822626.04, -154105.65, 5086486.04),
    "chime": (-2059166.313, -3621302.972, 4814304.113),
    "hartebeesthoek hart": (5085442.780, 2668263.483, -2768697.034),
}
# -----------------------------------------------------------------------------


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, z) with one lower-cased row for the name and one for the last token; the last line of a name holds."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("_n", parts.alias("p")).where((F.size("p") >= 4) & ~F.element_at("p", 1).startswith("#"))
    xyz = [F.element_at("p", i + 1).try_cast("double").alias(c) for i, c in enumerate("xyz")]
    names = F.array_distinct(F.array(F.lower(F.element_at("p", 4)), F.lower(F.element_at("p", -1))))
    made = rows.select("_n", *xyz, F.explode(names).alias("name")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return made.groupBy("name").agg(*[F.max_by(c, "_n").alias(c) for c in "xyz"])


def default_sites(spark: SparkSession) -> DataFrame:
    """(name, x, y, z) of the sites known without a file."""
    rows = [(alias, *xyz) for names, xyz in SITES.items() for alias in names.split()]
    return spark.createDataFrame(rows, "name string, x double, y double, z double")


def all_sites(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The sites of the file, if any, and those known without it for all other names."""
    known = default_sites(spark)
    if path is None:
        return known
    given = read_sites(spark, path)
    return given.unionByName(known.join(given.select("name"), "name", "left_anti").select(*given.columns))


def parse_solar_text(spark: SparkSession, text: str, *, marker: str = "SOLAR") -> DataFrame:
    """(sat, angle) of the lines ``<marker>\\t<sat>\\t<angle>`` in a tool's output, angles clipped to 0..180."""
    rows = []
    for line in text.splitlines():
        parts = line.strip().split("\t")
        if len(parts) == 3 and parts[0] == marker:
            try:
                rows.append((float(parts[1]), min(180.0, max(0.0, float(parts[2])))))
            except ValueError:
                continue
    return spark.createDataFrame(rows, "sat double, angle double")
