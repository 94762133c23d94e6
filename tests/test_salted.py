import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from residua.operators.salted import Partial, heavy_keys, salted_aggregate


def test_equals_plain_aggregation(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 40, n).astype(str)), "v": rng.normal(size=n).round(3), "w": rng.integers(0, 5, n).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "7", F.col("k"))).withColumn("v", F.when(F.col("w") > 0, F.col("v")))
    aggs = {"n": Partial.count(), "pos": Partial.count(F.col("v") > 0), "s": Partial.total(F.col("v")), "lo": Partial.least(F.col("v")), "hi": Partial.most(F.col("v")), "m": Partial.weighted_mean(F.col("v"), F.col("w"))}
    got = {r["k"]: r for r in salted_aggregate(df, ["k"], aggs, identity=["id"], salts=8, share=0.05).collect()}
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("pos"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum(F.col("v") * F.col("w")) / F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias("m")).collect()
    assert len(got) == len(want) and None in got
    for r in want:
        g = got[r["k"]]
        assert (g["n"], g["pos"], g["lo"], g["hi"]) == (r["n"], r["pos"], r["lo"], r["hi"])
        assert np.isclose(g["s"], r["s"]) and np.isclose(g["m"], r["m"])
    assert [r[0] for r in heavy_keys(df, ["k"], 0.05).collect()] == ["hot"]


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k string, v double")
    assert salted_aggregate(df, ["k"], {"n": Partial.count()}, identity=["id"]).count() == 0


def test_hot_part_of_the_key(spark):
    """Every key of a hot group is salted, and the rows are those of the plain aggregation."""
    df = spark.range(3000).selectExpr("id", "if(id % 10 < 7, 'hot', concat('g', id % 300)) as g", "cast(id % 50 as int) as day")
    got = salted_aggregate(df, ["g", "day"], {"n": Partial.count()}, identity=["id"], salts=4, share=0.1, hot_by=["g"])
    assert {(r["g"], r["day"], r["n"]) for r in got.collect()} == {(r["g"], r["day"], r["count"]) for r in df.groupBy("g", "day").count().collect()}
    assert "_h_g" in got._jdf.queryExecution().analyzed().toString() and "_h_day" not in got._jdf.queryExecution().analyzed().toString()
