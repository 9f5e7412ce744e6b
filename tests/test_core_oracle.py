import pytest

from corpuslens.plans.registry import core_queries, core_sql
from oracle import compare

Q, S = core_queries(), core_sql()


@pytest.mark.parametrize("name", sorted(S))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0
