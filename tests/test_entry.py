import __spark_entry__


def test_queries_and_sql_agree():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 40
    assert {f"p{n}_found" for n in (2, 3, 4)} <= set(q)


def test_entry(spark):
    assert [f.name for f in __spark_entry__.entry(spark).schema.fields] == ["toa_id", "kind"]
