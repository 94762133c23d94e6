import numpy as np

from residua.operators.line_grammar import parse_lines
from residua.operators.ou import innovations
from residua.streaming.rows import stream_daily_faults, stream_innovations


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.sql(f"select * from {name}").collect()
    finally:
        q.stop()


def test_innovations_equal_the_batch(spark, series, tmp_path):
    rng = np.random.default_rng(6)
    df = series(50000 + rng.uniform(0, 1, 60), rng.normal(size=60), 1.0, grp=rng.choice(["a", "b"], 60))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r["toa_id"]: r["z"] for r in drain(stream_innovations(src, ["series_id", "grp"], tau=0.02), "innov")}
    want = {r["toa_id"]: r["ou_e"] / r["ou_a"] ** 0.5 for r in innovations(df, ["series_id", "grp"], tau=0.02).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_daily_counts_and_lines(spark, tmp_path):
    schema = "toa_id long, grp string, mjd double, resid double, sigma double, loaded_at timestamp, line string"
    rows = [(1, "g", 50000.0, 5.0, 1e-6), (2, "g", 50000.0, 1e-6, 1e-6)]
    src = spark.createDataFrame(rows, "toa_id long, grp string, mjd double, resid double, sigma double").selectExpr("*", "timestamp'2020-01-01 10:00:00' as loaded_at", "'TIME' as line")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = drain(stream_daily_faults(stream), "daily", "complete")
    assert [(r["grp"], r["n"], r["n_impossible"]) for r in out] == [("g", 2, 1)]
    assert [r["reason"] for r in drain(parse_lines(stream, keep=["toa_id"]), "lines")] == ["columns", "columns"]
