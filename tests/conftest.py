import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Builds a frame of series rows from columns; toa_id counts up."""

    def make(mjd, resid, sigma, freq=None, grp="g", series_id="s", **more):
        import numpy as np
        import pandas as pd

        n = len(mjd)
        pdf = pd.DataFrame({"toa_id": np.arange(n, dtype=np.int64), "mjd": np.asarray(mjd, float), "resid": np.asarray(resid, float), "sigma": np.broadcast_to(sigma, n).astype(float)})
        pdf["freq"] = np.broadcast_to(1400.0 if freq is None else freq, n).astype(float)
        pdf["grp"], pdf["series_id"] = grp, series_id
        pdf["day"] = np.floor(pdf["mjd"]).astype(np.int64)
        for k, v in more.items():
            pdf[k] = v
        return spark.createDataFrame(pdf)

    return make
