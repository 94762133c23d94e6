"""System and group keys from file names, flags and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators.blocks import exact_medians, small
from residua.operators.series_faults import placeholder

# fixed values: telescope prefixes of file names
KNOWN_TELS = ("EFF", "JBO", "NRT", "WSRT", "SRT", "LEAP")


def file_triplet(path: Column) -> Column:
    """struct(tel, backend, band) of TEL[.BACKEND][.BAND].tim; nulls where the name has another form."""
    base = F.trim(F.regexp_extract(path, r"([^/]*)$", 1))
    name = F.regexp_replace(base, r"\.tim$", "")
    parts = F.split(name, r"\.")
    tel = F.upper(F.get(parts, F.lit(0)))
    known = ~F.lower(base).endswith("_all.tim") & tel.isin(*KNOWN_TELS)
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    number = second.try_cast("double")
    two = F.size(parts) == 2
    backend = F.when(two, F.when(number.isNull(), second)).otherwise(second)
    band = F.when(two, number).otherwise(third.try_cast("double"))
    when = lambda c: F.when(known, c)
    return F.struct(when(tel).alias("tel"), when(backend).alias("backend"), when(band).alias("band"))


def ensure_sys_group(df: DataFrame, *, file: str = "_timfile", base: str = "_timfile_base", filename: str = "filename", freq: str = "freq", cenfreq: str = "cenfreq", sys: str = "sys", group: str = "grp", backends: tuple[str, ...] = ("be", "i", "r")) -> DataFrame:
    """Fills sys and group that are null or placeholders: TEL.BACKEND.CHANNEL and TEL.BACKEND.BAND.

    tel: file name, else the prefix of sys or group; backend: file name, else a
    backend flag; band: the row's cenfreq, the file name's, the file's median
    cenfreq, its median freq, the row's channel.  What stays open is UNK.
    Names are parsed once for each file, not for each row.
    """
    has = set(df.columns)
    mid = exact_medians(df, [file], {"_mf": freq} | ({"_mc": cenfreq} if cenfreq in has else {}))
    if cenfreq not in has:
        mid = mid.withColumn("_mc", F.lit(None).cast("double"))
    guess = F.col(file)
    if base in has:
        guess = F.coalesce(F.nullif(F.col(base), F.lit("")), F.col(file))
    names = df.select(guess.alias("_guess")).where(F.col("_guess").isNotNull()).distinct()
    parsed = small(names.select("_guess", file_triplet(F.col("_guess")).alias("_a")))
    out = df.join(small(mid), file, "left").withColumn("_guess", guess).join(parsed, "_guess", "left").drop("_guess")
    named = F.when(F.lower(filename).endswith(".tim"), file_triplet(F.col(filename))) if filename in has else None
    use_name = F.col("_a.tel").isNull() & (named["tel"].isNotNull() if named is not None else F.lit(False))
    pick = lambda c: F.when(use_name, named[c]).otherwise(F.col(f"_a.{c}")) if named is not None else F.col(f"_a.{c}")
    prefix = lambda c: F.when(F.col(c).contains("."), F.split(F.col(c), r"\.")[0]) if c in has else F.lit(None).cast("string")
    tel = F.coalesce(pick("tel"), F.coalesce(prefix(sys), prefix(group)), F.lit("UNK"))
    flags = [F.col(c).cast("string") for c in backends if c in has]
    backend = F.upper(F.coalesce(pick("backend"), *flags, F.lit("UNK")))
    whole = lambda c: F.rint(c).cast("bigint").cast("string")
    channel = whole(F.col(freq))
    own = whole(F.col(cenfreq)) if cenfreq in has else F.lit(None).cast("string")
    band = F.coalesce(own, whole(pick("band")), whole(F.col("_mc")), whole(F.col("_mf")), channel, F.lit("UNK"))
    make = lambda last: F.concat_ws(".", tel, backend, last)
    old = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    fill = lambda c, new: F.when(placeholder(old(c)), new).otherwise(old(c))
    made = out.withColumns({"_sys": fill(sys, make(F.coalesce(channel, F.lit("UNK")))), "_grp": fill(group, make(band))})
    return made.withColumn(sys, F.col("_sys")).withColumn(group, F.col("_grp")).drop("_sys", "_grp", "_a", "_mf", "_mc")
