import pytest

from compare import same
from leitmotiv.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "d"
    assert set(entry.oracle_sql()) <= set(entry.queries())
