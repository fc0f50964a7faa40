import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["l_returnflag", "sum(l_quantity)", "avg(l_extendedprice)", "count(*)"]
    assert out.count() == 3
