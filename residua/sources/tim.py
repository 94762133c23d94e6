"""Timing files: include walk, TIME offsets and the permissive line layouts.

The strict reader with located errors is ``operators.line_grammar``; this one
takes every line that has three consecutive numbers after a name.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.operators.blocks import small

from residua.operators.line_grammar import CONTROL_HEADS

#: a number as the permissive reader takes it, with d exponents and commas
NUMBER = r"^[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eEdD][+-]?[0-9]+)?$"


def number(token: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(token, ",", ""), "[dD]", "e")
    return F.when(token.rlike(NUMBER), clean.try_cast("double"))


def permissive_records(lines: DataFrame, *, line: str = "line", file: str = "_timfile", line_no: str = "line_no", base_offset: str | None = None, extra_control: tuple[str, ...] = ()) -> DataFrame:
    """Adds kind, sat_raw, sat_corr, filename, freq, mjd, toaerr_tim, tel, flags and _time_offset_sec to each line.

    kind: blank, comment, control, time, include, toa or dropped.  Offsets are
    the running sum of TIME arguments above the line in its file, on top of
    ``base_offset`` (a column).  Layouts in order: sat name freq mjd err, name
    freq mjd err, else the first three consecutive numbers not at the start.

    Defined cases: a null line is blank; a TIME line without a number counts as
    dropped and moves nothing; of repeated flags the last holds; a flag never
    overwrites a column; an empty table gives an empty result.
    """
    text = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\s+", " "))
    out = lines.withColumn("_tok", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ")))
    out = out.withColumn("_num", F.transform("_tok", number))
    head = F.get("_tok", F.lit(0))
    num = lambda i: F.get("_num", F.lit(i))
    tok = lambda i: F.get("_tok", F.lit(i))
    size = F.size("_tok")
    a = num(0).isNotNull() & (size >= 5) & num(2).isNotNull() & num(3).isNotNull() & num(4).isNotNull()
    b = (size >= 4) & num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull()
    three = F.filter(F.sequence(F.lit(1), F.greatest(size - 3, F.lit(1))), lambda i: F.get("_num", i).isNotNull() & F.get("_num", i + 1).isNotNull() & F.get("_num", i + 2).isNotNull())
    start = F.when(a, F.lit(2)).when(b, F.lit(1)).otherwise(F.get(three, F.lit(0)))
    out = out.withColumn("_at", F.when(size >= 4, start).cast("int"))
    kind = (
        F.when(size == 0, "blank")
        .when(head.isin("C", "#"), "comment")
        .when(head.isin(*sorted(CONTROL_HEADS), *extra_control), "control")
        .when(F.upper(head) == "TIME", F.when(num(1).isNotNull(), "time").otherwise("dropped"))
        .when(F.upper(head) == "INCLUDE", F.when(size >= 2, "include").otherwise("dropped"))
        .when(F.col("_at").isNotNull(), "toa")
        .otherwise("dropped")
    )
    out = out.withColumn("kind", kind)
    moved = F.sum(F.when(F.col("kind") == "time", num(1)).otherwise(0.0)).over(Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0))
    base = F.col(base_offset) if base_offset else F.lit(0.0)
    out = out.withColumn("_time_offset_sec", moved + base)
    at = F.col("_at")
    toa = lambda c: F.when(F.col("kind") == "toa", c)
    first_flag = lambda i: F.get("_tok", i).startswith("-") & F.get("_num", i).isNull()
    sat = F.when(a, num(0)).otherwise(F.get("_num", at + 1))
    flag_names = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i >= at + 3) & first_flag(i))
    entry = lambda i: F.struct(F.substring(F.get("_tok", i), F.lit(2), F.length(F.get("_tok", i))), F.when(F.get("_tok", i + 1).isNull() | first_flag(i + 1), F.lit("true")).otherwise(F.get("_tok", i + 1)))
    # step by step, so that no step's arrays are made once per use
    out = out.withColumn("_pairs", F.transform(flag_names, entry)).withColumn("_names", F.transform("_pairs", lambda p: p["col1"]))
    pairs, names = F.col("_pairs"), F.col("_names")
    last = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: F.array_position(F.slice(names, i + 2, F.size(names) + 1), F.get(names, i)) == 0)
    flags = F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(last, lambda i: F.get(pairs, i)))).otherwise(F.create_map().cast("map<string,string>"))
    out = out.withColumns({
        "sat_raw": toa(sat),
        "sat_corr": toa(sat + F.col("_time_offset_sec") / F.lit(86400.0)),
        "filename": toa(F.get("_tok", at - 1)),
        "freq": toa(F.get("_num", at)),
        "mjd": toa(F.get("_num", at + 1)),
        "toaerr_tim": toa(F.get("_num", at + 2)),
        "tel": toa(F.when(~first_flag(at + 3), F.get("_tok", at + 3))),
        "flags": toa(flags),
    })
    return out.drop("_tok", "_num", "_at", "_pairs", "_names")


@dataclass(frozen=True)
class TimParseResult:
    """TOA rows with their counters."""

    df: DataFrame
    stats: dict[str, float]


def _walk(spark: SparkSession, top: str) -> list[tuple[str, str, float]]:
    """(visit, path, base offset) of the file and all it includes; a file may be visited more than once.

    Only INCLUDE lines, one for each file to read, come to the driver, level by
    level, each with the sum of the offsets before it.
    """
    visits, level = [], [("0", top, 0.0)]
    for depth in range(64):
        if not level:
            return visits
        visits += level
        src = spark.createDataFrame([(v, p) for v, p, _ in level], "visit string, path string")
        text = _lines(spark, sorted({p for _, p, _ in level}))
        moves = src.join(text, "path").withColumn("_t", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
        head = F.upper(F.get("_t", F.lit(0)))
        moves = moves.where(head.isin("TIME", "INCLUDE")).select("visit", "line_no", head.alias("head"), F.get("_t", F.lit(1)).alias("arg"))
        moved = F.sum(F.when(F.col("head") == "TIME", F.coalesce(number(F.col("arg")), F.lit(0.0))).otherwise(0.0)).over(Window.partitionBy("visit").orderBy("line_no"))
        found = moves.withColumn("moved", moved).where("head = 'INCLUDE' and arg <> ''").orderBy("visit", "line_no")
        of = {v: (p, base) for v, p, base in level}
        level = []
        for r in found.toLocalIterator():
            path, base = of[r["visit"]]
            level.append((f"{r['visit']}.{r['line_no']}", posixpath.join(posixpath.dirname(path), r["arg"].strip('"')), base + r["moved"]))
    raise ValueError("INCLUDE lines nest deeper than 64 levels")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Numbered lines; a file of any size is read in blocks, whose lines are counted to number those of the next."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    rows = spark.read.text(paths).select(path.alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    per = rows.groupBy("path", "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.join(small(per.select("path", "_b", before.alias("_before"))), ["path", "_b"])
    place = F.row_number().over(Window.partitionBy("path", "_b").orderBy("_i"))
    return at.select("path", (F.col("_before") + place).cast("int").alias("line_no"), "line")


def parse_all_timfiles(spark: SparkSession, top: str, *, extra_control: tuple[str, ...] = ()) -> TimParseResult:
    """All TOAs of a timing file and the files it includes, with counts; raises if there is none."""
    visits = _walk(spark, top)
    src = spark.createDataFrame(visits, "visit string, path string, base double")
    lines = src.join(_lines(spark, sorted({p for _, p, _ in visits})), "path")
    rows = permissive_records(lines, file="visit", base_offset="base", extra_control=extra_control)
    toas = rows.where("kind = 'toa'").drop("kind", "line", "base", "visit").withColumnRenamed("path", "_timfile").withColumn("_timfile_base", F.regexp_extract("_timfile", r"([^/]*)$", 1))
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not counts.get("toa"):
        raise RuntimeError(f"no TOA in {top}")
    largest = rows.agg(F.max(F.abs("_time_offset_sec")).alias("m")).first()["m"]
    stats = {"files": len(visits), **{k: counts.get(k, 0) for k in ("toa", "comment", "control", "time", "include", "dropped", "blank")}, "max_abs_offset_sec": float(largest or 0.0)}
    for name in ("cenfreq", "bw"):
        toas = toas.withColumn(name, F.col("flags")[name].try_cast("double"))
    for name in ("be", "sys"):
        toas = toas.withColumn(name, F.col("flags")[name])
    toas = toas.withColumn("grp", F.col("flags")["group"]).withColumn("meta_id", F.xxhash64("_timfile", "line_no", "_time_offset_sec"))
    return TimParseResult(toas, stats)
