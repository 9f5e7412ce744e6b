import pytest

from corpuslens.llm.queries import QUERIES, SQL
from oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], SQL[name])
