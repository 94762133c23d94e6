"""Timing rows as a stream: innovations with per-series state, and daily counts with a watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from residua.operators.series_faults import FaultConfig, impossible


def stream_innovations(rows: DataFrame, keys: list[str], *, tau: float, q: float = 0.0) -> DataFrame:
    """(keys, toa_id, mjd, z) of each row against the latest earlier row of its series.

    The state is one row per series.  Rows of a batch are taken in time order;
    a row that is older than the state is held against nothing (z is null) and
    does not change it.
    """
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for pdf in batches:
            out = []
            for r in pdf.sort_values(["mjd", "toa_id"]).itertuples(index=False):
                t, y, s = float(r.mjd), float(r.resid), float(r.sigma)
                if last is None:
                    z = y / math.sqrt(s * s + q)
                elif t < last[0]:
                    out.append((*key, r.toa_id, t, None))
                    continue
                else:
                    phi = math.exp(-(t - last[0]) / tau) if tau > 0 else 0.0
                    z = (y - phi * last[1]) / math.sqrt(s * s + phi * phi * last[2] * last[2] + q * (1 - phi * phi))
                last = (t, y, s)
                out.append((*key, r.toa_id, t, z))
            yield pd.DataFrame(out, columns=[*keys, "toa_id", "mjd", "z"])
        if last is not None:
            state.update(last)

    usable = rows.where(F.col("mjd").isNotNull() & F.col("resid").isNotNull() & (F.col("sigma") > 0)).select(*keys, "toa_id", "mjd", "resid", "sigma")
    return usable.groupBy(*keys).applyInPandasWithState(step, f"{fields}, toa_id long, mjd double, z double", "t double, y double, s double", "append", GroupStateTimeout.NoTimeout)


def stream_daily_faults(rows: DataFrame, *, loaded: str = "loaded_at", late: str = "30 days", cfg: FaultConfig = FaultConfig()) -> DataFrame:
    """Rows and impossible rows for each day of loading and group; days close when the watermark has passed them."""
    wild = impossible(F.col("resid"), F.col("sigma"), F.col("mjd"), cfg)
    timed = rows.withColumn("_at", F.col(loaded).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", "1 day").alias("loaded_day"), "grp").agg(F.count("*").alias("n"), F.count_if(wild).alias("n_impossible"))
