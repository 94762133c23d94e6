import json

import pytest

from residua.operators.asof import merge_time_and_meta
from residua.operators.blocks import ranked
from residua.options import Settings, options
from residua.plans.settings import write_models
from residua.session import shared_folder
from residua.sources.observatory import all_sites


def test_options_are_read_by_name_and_checked():
    dip = options("dip", points=8)
    assert (dip.points, dip.reach, dip.colour_range) == (8, 5.0, (2.0, 4.0)) and dip.but(points=6) == options("dip")
    with pytest.raises(TypeError, match="no option"):
        options("dip", nothing=1)
    with pytest.raises(AttributeError):
        dip.nothing
    cfg = Settings(dip=dip, step={"on": False})
    assert cfg.dip is dip and not cfg.step.on and cfg.dm_step.on and cfg != Settings() and cfg.but(dip={"points": 6}, step={"on": True}) == Settings()
    for wrong in ({"nothing": {}}, {"dip": options("bump")}):
        with pytest.raises(TypeError):
            Settings(**wrong)


def test_merge_without_channels(spark):
    toas = spark.createDataFrame([(1, "p", 50000.0, 1400.0), (2, "p", 50001.0, None)], "toa_id long, psr string, mjd double, freq double")
    meta = spark.createDataFrame([(7, "p", 50000.0, 50000.0, 700.0, "a"), (8, "p", 50001.0, None, None, "b")], "meta_id long, psr string, mjd double, sat_corr double, freq double, filename string")
    got = {r["toa_id"]: r["meta_id"] for r in merge_time_and_meta(toas, meta, options("merge", channel_mhz=None)).collect()}
    assert got == {1: 7, 2: 8}


def test_places_in_a_global_order(spark):
    df = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(101)] + [(500, 5.0), (501, None)], "id long, t double")
    out, n = ranked(df, ["t", "id"], "k")
    want = [r["id"] for r in df.orderBy("t", "id").collect()]
    assert n == 103 and [r["id"] for r in sorted(out.collect(), key=lambda r: r["k"])] == want and sorted(r["k"] for r in out.collect()) == list(range(1, 104))
    empty, none = ranked(df.where("false"), ["t"], "k")
    assert none == 0 and empty.count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    class Fake:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Fake)
    Fake.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Fake)


def test_sites_known_without_a_file(spark, tmp_path):
    (tmp_path / "sites.dat").write_text("1.0 2.0 3.0 WSRT w\n")
    got = {r["name"]: r["x"] for r in all_sites(spark, str(tmp_path / "sites.dat")).collect()}
    assert got["wsrt"] == 1.0 and got["w"] == 1.0 and got["eff"] == 4033949.5 and len(got) == len(set(got))


def test_models_have_the_header_of_their_run(spark, tmp_path):
    models = spark.createDataFrame([("x", "g", 1, 0.5, 1.0, 9, 2.0, 1.0), ("x", "g", 0, 0.0, 0.5, 8, 1.0, 1.0)], "feature string, grp string, bin long, edge_lo double, edge_hi double, n long, mean double, weight double")
    write_models(models, str(tmp_path / "m"), run={"par": "a.par"})
    (row,) = [json.loads(x) for f in (tmp_path / "m").glob("*.json") for x in f.read_text().splitlines()]
    assert row["run"]["par"] == "a.par" and row["run"]["group_cols"] == ["grp"] and row["group_key"] == {"grp": "g"}
    assert row["model"] == {"edges_lo": [0.0, 0.5], "edges_hi": [0.5, 1.0], "n": [8, 9], "means": [1.0, 2.0]}
