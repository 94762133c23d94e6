"""Means, scales and tests of residuals binned by a covariate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.options import Options, options
from residua.functions.stats import chi2_tail, folded_distance
from residua.operators.blocks import exact_median, largest_group, small
from residua.operators.outliers import with_group_value


def _feature(name: str, circular: bool) -> Column:
    return F.pmod(F.col(name), F.lit(1.0)) if circular else F.col(name)


def with_bins(df: DataFrame, keys: list[str], feature: str, good: Column, *, nbins: int, min_per_bin: int, circular: bool) -> DataFrame:
    """Adds _x, _edges and _bin (from 0) of each row's group; null where the feature is.

    The number of bins is min(nbins, max(3, n // min_per_bin)) for n good rows.
    Edges are evenly spaced over the range of the good rows, or over 0..1 for a
    circular feature; a range of one value makes one bin.
    """
    out = df.withColumn("_x", _feature(feature, circular)).withColumn("_good", F.coalesce(good & F.col("_x").isNotNull(), F.lit(False)))
    x = F.when(F.col("_good"), F.col("_x"))
    per = out.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n")).where(F.col("_n") > 0)
    if circular:
        per = per.withColumns({"_lo": F.lit(0.0), "_hi": F.lit(1.0)})
    wanted = F.greatest(F.lit(3), F.floor(F.col("_n") / max(1, min_per_bin)))
    if nbins > 0:
        wanted = F.least(F.lit(nbins), wanted)
    per = per.withColumn("_nb", F.when(F.col("_lo") == F.col("_hi"), F.lit(1)).otherwise(wanted).cast("int"))
    step = (F.col("_hi") - F.col("_lo")) / F.col("_nb")
    edge = lambda i: F.when(i == F.col("_nb"), F.col("_hi")).otherwise(i * step + F.col("_lo"))
    per = per.select(*keys, "_nb", F.transform(F.sequence(F.lit(0), F.col("_nb")), edge).alias("_edges"))
    out = with_group_value(out, per, keys)
    below = F.size(F.filter("_edges", lambda e: e <= F.col("_x"))) - 1
    return out.withColumn("_bin", F.when(F.col("_x").isNotNull(), F.greatest(F.lit(0), F.least(below, F.col("_nb") - 1))))


def _weights(sigma: str) -> Column:
    return F.when(F.col(sigma) > 0, F.lit(1.0) / (F.col(sigma) * F.col(sigma)))


def binned_means(df: DataFrame, keys: list[str], feature: str, *, resid: str, sigma: str, nbins: int, min_per_bin: int, circular: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with bins, model): the model has keys, bin, edge_lo, edge_hi, n, mean, weight of populated bins."""
    good = F.col(resid).isNotNull() & F.col(sigma).isNotNull() & (F.col(sigma) > 0)
    rows = with_bins(df, keys, feature, good, nbins=nbins, min_per_bin=min_per_bin, circular=circular)
    w = _weights(sigma)
    model = rows.where("_good").groupBy(*keys, F.col("_bin").alias("bin")).agg(
        F.first("_edges").alias("_edges"), F.count("*").alias("n"), (F.sum(w * F.col(resid)) / F.sum(w)).alias("mean"), F.sum(w).alias("weight")
    )
    model = model.where(F.col("n") >= min_per_bin)
    edge = lambda i: F.get("_edges", i)
    model = model.select(*keys, "bin", edge(F.col("bin")).alias("edge_lo"), edge(F.col("bin") + 1).alias("edge_hi"), "n", "mean", "weight")
    return rows, small(model)


def structure_test(df: DataFrame, keys: list[str], feature: str, cfg: Options = options("structure"), *, resid: str = "resid", sigma: str = "sigma") -> DataFrame:
    """(keys, chi2, dof, p, present) of the binned means against zero; groups without usable rows have none."""
    _, model = binned_means(df, keys, feature, resid=resid, sigma=sigma, nbins=cfg.bins, min_per_bin=cfg.per_bin, circular=feature in cfg.circular)
    out = model.groupBy(*keys).agg(F.sum(F.col("mean") * F.col("mean") * F.col("weight")).alias("chi2"), F.count("*").alias("dof"))
    out = out.withColumn("p", chi2_tail(F.col("chi2"), F.col("dof")))
    return out.withColumn("present", F.coalesce(F.col("p") < cfg.level, F.lit(False)))


def with_structure(df: DataFrame, keys: list[str], cfg: Options, *, resid: str = "resid", sigma: str = "sigma") -> DataFrame:
    """Adds structure_<feature>_{chi2,dof,p,present} and structure_present_<feature> of each row's group."""
    out = df
    for f in cfg.test:
        test = structure_test(df, keys, f, cfg, resid=resid, sigma=sigma)
        named = test.select(*keys, *[F.col(c).alias(f"structure_{f}_{c}") for c in ("chi2", "dof", "p", "present")])
        out = with_group_value(out, named, keys).fillna(0, subset=[f"structure_{f}_dof"]).fillna(False, subset=[f"structure_{f}_present"])
        out = out.withColumn(f"structure_present_{f}", F.col(f"structure_{f}_present"))
    return out


def detrend(df: DataFrame, keys: list[str], features: tuple[str, ...], *, resid: str = "resid", sigma: str = "sigma", out: str = "resid_detr", nbins: int = 12, min_per_bin: int = 5, circular: tuple[str, ...] = ("orbital_phase",)) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``out``, models): binned means of each feature subtracted one after the other.

    Rows whose feature is null or whose bin is too thin keep their value.
    Models carry a ``feature`` column.  A feature that is no column counts as null.
    """
    cur, models = df.withColumn(out, F.col(resid)), None
    for f in features:
        if f not in df.columns:
            continue
        rows, model = binned_means(cur, keys, f, resid=out, sigma=sigma, nbins=nbins, min_per_bin=min_per_bin, circular=f in circular)
        named = model.select(*keys, F.col("bin").alias("_bin"), F.col("mean").alias("_mean"))
        cur = rows.join(named, [*keys, "_bin"], "left").withColumn(out, F.col(out) - F.coalesce("_mean", F.lit(0.0)))
        cur = cur.drop("_mean", "_bin", "_x", "_good", "_nb", "_edges")
        one = model.select(F.lit(f).alias("feature"), *model.columns)
        models = one if models is None else models.unionByName(one)
    return cur, models


def rescale(df: DataFrame, keys: list[str], feature: str, *, resid: str = "resid", sigma: str = "sigma", out_resid: str = "resid_proc", out_sigma: str = "sigma_proc", nbins: int = 12, min_per_bin: int = 5, circular: bool = False) -> DataFrame:
    """Adds resid and sigma over 1.4826 MAD of their bin; bins that are thin or without spread keep 1."""
    good = F.col(resid).isNotNull() & F.col(sigma).isNotNull()
    rows = with_bins(df, keys, feature, good, nbins=nbins, min_per_bin=min_per_bin, circular=circular)
    by = [*keys, "_bin"]
    used = rows.where("_good").select(*by, F.col(resid).alias("_r"))
    largest = largest_group(used, by)
    med = small(exact_median(used, by, "_r", "_med", largest=largest))
    dev = used.join(med, by).withColumn("_d", F.abs(F.col("_r") - F.col("_med")))
    counts = used.groupBy(*by).agg(F.count("*").alias("_c"))
    scale = exact_median(dev, by, "_d", "_mad", largest=largest).join(counts, by).where((F.col("_c") >= min_per_bin) & (F.col("_mad") > 0))
    scale = small(scale.select(*by, (F.lit(1.4826) * F.col("_mad")).alias("_scale")))
    out = rows.join(scale, by, "left").withColumn("_scale", F.coalesce("_scale", F.lit(1.0)))
    out = out.withColumn(out_resid, F.col(resid) / F.col("_scale")).withColumn(out_sigma, F.col(sigma) / F.col("_scale"))
    return out.drop("_x", "_good", "_nb", "_edges", "_bin", "_scale")


def preprocess(df: DataFrame, cfg: Options, *, resid: str = "resid") -> tuple[DataFrame, str | None, str | None, DataFrame | None]:
    """(rows, processed resid column, processed sigma column, models) with preproc_tag and preproc_notes."""
    keys = [c for c in cfg.within if c in df.columns] or ["grp"]
    out, r, s, models, tags = df, None, None, None, []
    if cfg.detrend:
        out, models = detrend(out, keys, cfg.detrend, resid=resid, nbins=cfg.bins, min_per_bin=cfg.per_bin, circular=cfg.circular)
        r, s = "resid_detr", "sigma"
        tags.append(f"detrend:{','.join(cfg.detrend)}")
    if cfg.rescale:
        out = rescale(out, keys, cfg.rescale, resid=r or resid, nbins=cfg.bins, min_per_bin=cfg.per_bin, circular=cfg.rescale in cfg.circular)
        r, s = "resid_proc", "sigma_proc"
        tags.append(f"rescale:{cfg.rescale}")
    notes = f"group_cols={tuple(keys)}; nbins={cfg.bins}; min_per_bin={cfg.per_bin}" if tags else ""
    return out.withColumns({"preproc_tag": F.lit("|".join(tags)), "preproc_notes": F.lit(notes)}), r, s, models


def orbital_cut(df: DataFrame, keys: list[str], cfg: Options, *, resid: str = "resid", sigma: str = "sigma", phase: str = "orbital_phase") -> DataFrame:
    """(keys, orbital_cut_phase): the first distance bin from which all medians of |r|/s stay at or below the threshold.

    If there is none, the mean centre of the bins at or below it; null if there
    is none of these either, or fewer than min_points usable rows.
    """
    n = cfg.bins
    valid = F.col(phase).isNotNull() & F.col(resid).isNotNull() & (F.col(sigma) > 0)
    rows = df.where(valid).select(*keys, folded_distance(F.col(phase), cfg.centre).alias("_d"), (F.abs(F.col(resid)) / F.col(sigma)).alias("_z"))
    edges = [0.5 if i == n else i * (0.5 / n) for i in range(n + 1)]
    rows = rows.withColumn("_bin", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("_d"))) - 1)
    enough = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= cfg.points)
    med = exact_median(rows.where(F.col("_bin") < n), [*keys, "_bin"], "_z", "_med")
    centres = F.array(*[F.lit(0.5 * (a + b)) for a, b in zip(edges, edges[1:])])
    tail = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    med = med.withColumns({"_tail": F.max("_med").over(tail), "_c": F.get(centres, F.col("_bin"))})
    cut = med.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_tail") <= cfg.sigmas, F.col("_c"))), F.avg(F.when(F.col("_med") <= cfg.sigmas, F.col("_c")))).alias("orbital_cut_phase"))
    return enough.join(cut, keys).select(*keys, "orbital_cut_phase")


def with_orbital_cut(df: DataFrame, keys: list[str], cfg: Options, *, resid: str = "resid", sigma: str = "sigma", phase: str = "orbital_phase") -> DataFrame:
    """Adds orbital_cut_phase, orbital_cut_sigma_thresh and orbital_phase_bad."""
    if cfg.limit is not None:
        out = df.withColumn("orbital_cut_phase", F.lit(float(cfg.limit)))
    else:
        out = with_group_value(df, orbital_cut(df, keys, cfg, resid=resid, sigma=sigma, phase=phase), keys)
    near = folded_distance(F.col(phase), cfg.centre) <= F.col("orbital_cut_phase")
    return out.withColumn("orbital_cut_sigma_thresh", F.lit(float(cfg.sigmas))).withColumn("orbital_phase_bad", F.coalesce(near, F.lit(False)))
