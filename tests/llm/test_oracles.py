import pytest

from skein.llm import queries
from tests.helpers import oracle_rows, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_the_other_engine(spark, duck, testdata, name):
    df = queries.QUERIES[name](spark, testdata)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df) == oracle_rows(rel)
