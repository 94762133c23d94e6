import json

import pytest

from residua.operators.drift import TYPES, DriftConfig, Field, compare, consistent_fields, field_profiles, flood, main_type, name_score, schema_drift, unified_table, unify


def dumps(spark, *records_of_dumps, campaign="c"):
    rows, rec = [], 0
    for no, records in enumerate(records_of_dumps, 1):
        for r in records:
            rec += 1
            rows.append((rec, no * 10, campaign, no, r if isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, "rec_id long, dump_id long, campaign string, dump_no int, record string")


def found(df):
    return {(r["dump_id"], r["field_old"], r["field_new"], r["drift"]) for r in schema_drift(df).collect()}


def rec(i, **names):
    base = {"freq": 1400.0 + i % 7, "bw": 48.0, "be": "ABC", "file": f"r{100 + i}.ar", "err": 0.5 + (i % 11)}
    for old, new in names.items():
        if new is None:
            base.pop(old)
        else:
            base[new] = base.pop(old)
    return base


def test_kinds(spark):
    one = [rec(i) for i in range(12)]
    two = [rec(i, freq="obsfreq", bw=None) | {"ok": True} for i in range(12, 24)]
    three = [rec(i, freq="obsfreq", bw=None) | {"ok": True, "err": str(0.5 + i % 11)} for i in range(12)]
    assert found(dumps(spark, one, two, three)) == {(20, "freq", "obsfreq", "renamed"), (20, "bw", "", "removed"), (20, "", "ok", "added"), (30, "err", "err", "retyped")}


def test_unrelated_fields_are_not_renames(spark):
    one = [rec(i, err=None) | {"snr": 100.0 + 13 * i} for i in range(12)]
    two = [rec(i, err=None) | {"gof": 0.8 + 0.05 * i} for i in range(12)]
    assert found(dumps(spark, one, two)) == {(20, "snr", "", "removed"), (20, "", "gof", "added")}


def test_null_fields_bad_records_and_first_dumps(spark):
    one = [{"a": 1, "b": None}, {"a": 2}]
    two = ["no json", "[1]", {"a": None, "b": "x"}, {"a": None}]
    assert found(dumps(spark, one, two)) == set()
    assert found(dumps(spark, one, ["broken"])) == {(20, "a", "", "removed"), (20, "b", "", "removed")}
    assert found(dumps(spark, one)) == set()
    assert found(dumps(spark, one).where("false")) == set()


def test_gaps_and_clashing_columns(spark):
    df = dumps(spark, [{"a": 1}], [{"a": 1}], [{"a": "x"}]).where("dump_no <> 2").selectExpr("*", "1 as name", "2 as kind", "3 as _c")
    assert found(df) == {(30, "a", "a", "retyped")}


def test_unified_table(spark):
    one = [rec(i) for i in range(12)]
    two = [rec(i, freq="obsfreq", bw="BW") for i in range(12, 24)]
    two[0]["BW"] = "n/a"
    two[1]["obsfreq"] = "1,401.5 MHz"
    two[2]["obsfreq"] = {"value": 1399.5, "unit": "MHz"}
    out = {r["rec_id"]: r for r in unified_table(dumps(spark, one, two)).collect()}
    assert out[1]["freq"] == 1400.0 and out[14]["freq"] == 1401.5 and out[15]["freq"] == 1399.5
    assert out[13]["bw"] is None and out[13]["_uncast"] == ["bw"] and out[24]["bw"] == 48.0


def test_names_are_bounded(spark):
    df = dumps(spark, [{f"f{i}": i for i in range(20)}])
    p = field_profiles(df, record="record", campaign="campaign", dump_no="dump_no", dump_id="dump_id")
    with pytest.raises(ValueError, match="field names"):
        consistent_fields(p, schema_drift(df), max_names=5)


def test_pieces():
    assert name_score("TEL", "tel") == 1.0 and name_score("bw", "band_width") >= 0.6 and name_score("freq", "x") == 0.0
    f = dict.fromkeys(["n_number", "n_string", "n_boolean", "n_object", "n_array"], 0)
    assert main_type(f) is None and main_type(f | {"n_string": 2, "n_number": 1}) == "string"
    assert compare({}, {}, DriftConfig()) == []


def test_names_of_one_dump_are_never_one_field(spark):
    """A rename seen elsewhere does not merge two fields that stand side by side; unify lists what a further name holds."""
    one, two = [{"a": 1.5 + i} for i in range(12)], [{"b": 1.5 + i} for i in range(12)]
    both = [{"a": 1.5 + i, "b": 2.5 + i} for i in range(12)]
    apart = dumps(spark, one, two).unionByName(dumps(spark, both, campaign="d"))
    assert (20, "a", "b", "renamed") in found(apart)
    where = dict(record="record", campaign="campaign", dump_no="dump_no", dump_id="dump_id")
    fields = consistent_fields(field_profiles(apart, **where), schema_drift(apart))
    assert {f.name for f in fields} == {"a", "b"}
    rows = unify(spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"b": 3}',)], "record string"), [Field("a", "double", ("a", "b"))]).collect()
    assert [(r["a"], [tuple(o) for o in r["_others"]]) for r in rows] == [(1.0, [("a", "b", "2")]), (3.0, [])]


def test_flooding_decides(spark):
    """Names alone, or values of other fields, do not bring these renames; without a round of flooding they are lost."""
    one = [rec(i) for i in range(12)]
    two = [rec(i, freq="nu", err="uncertainty") for i in range(12, 24)]
    df = dumps(spark, one, two)
    assert found(df) == {(20, "freq", "nu", "renamed"), (20, "err", "uncertainty", "renamed")}
    assert not any(r["drift"] == "renamed" for r in schema_drift(df, cfg=DriftConfig(rounds=0)).collect())


def test_nesting_and_neighbours_take_part():
    """Of two candidates with the same values the one whose inner names and neighbours agree wins."""
    base = {f"n_{t}": 0 for t in TYPES} | {"n": 9, "n_num": 9, "lo": 1.0, "hi": 9.0, "q": [2.0, 4.0, 8.0], "shape": None, "text_min": None, "text_max": None, "inner": None}
    obj = lambda inner: base | {"n_object": 9, "inner": inner}
    old = {"x": obj("OBJECT<unit: STRING, value: DOUBLE>"), "s": base | {"n_number": 9}}
    new = {"p": obj("OBJECT<flag: BOOLEAN, other: BOOLEAN>"), "q": obj("OBJECT<unit: STRING, value: DOUBLE>"), "s": base | {"n_number": 9}}
    a, b, score, _ = flood(old, new, DriftConfig())
    assert a == ["x"] and b == ["p", "q"] and score[0, 1] > score[0, 0]
    far = base | {"n_number": 9, "q": [2.0, 400.0, 800.0]}
    apart = flood({"x": base | {"n_number": 9}, "s": base | {"n_number": 9}}, {"y": base | {"n_number": 9}, "s": base | {"n_number": 9}}, DriftConfig())[2]
    alone = flood({"x": base | {"n_number": 9}, "s": base | {"n_number": 9}}, {"y": base | {"n_number": 9}, "s": far}, DriftConfig())[2]
    assert apart[0, 0] > alone[0, 0]


def test_scores_settle_to_the_same():
    """More rounds change nothing once the scores have settled."""
    f = {f"n_{t}": 0 for t in TYPES} | {"n": 9, "n_number": 9, "n_num": 9, "lo": 1.0, "hi": 9.0, "q": [2.0, 4.0, 8.0], "shape": None, "text_min": None, "text_max": None, "inner": None}
    few, many = (flood({"x": f, "s": f}, {"y": f, "s": f}, DriftConfig(rounds=n, settled=0.0))[2] for n in (60, 400))
    assert abs(few - many).max() < 1e-9
