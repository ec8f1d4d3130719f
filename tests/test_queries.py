"""Every registered query beside its SQL, over the smallest tables."""

import oracle
import pytest

from boutforge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    assert oracle.same(ours, duck.sql(registry.ORACLE_SQL[name]).df()) == ""


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
