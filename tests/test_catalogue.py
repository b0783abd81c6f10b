import pytest

from skein import catalogue
from tests.helpers import oracle_rows, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_the_other_engine(spark, duck, testdata, name):
    df = catalogue.QUERIES[name](spark, testdata)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df) == oracle_rows(rel)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, testdata, name):
    assert catalogue.QUERIES[name](spark, testdata).count() >= 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_tables(spark, duck, testdata):
    whole = lambda name: catalogue.QUERIES[name](spark, testdata)
    assert whole("merger").count() == duck.sql("select count(*) from orders").fetchall()[0][0] > 50
    assert whole("is_null").where("event_id >= 500").count() > 0
    ends = {r.t for r in whole("recursive_union").select("t").distinct().collect()}
    assert ends == {r[0] for r in duck.sql("select distinct c_custkey from customer").fetchall()} and len(ends) > 11
    held = [tuple(r) for r in duck.sql("select p_partkey, p_brand, p_size from part").fetchall()]
    assert whole("self_join").count() == sum(a[1:] == b[1:] and a[0] < b[0] for a in held for b in held)
