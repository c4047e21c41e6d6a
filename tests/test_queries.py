"""Every query of the rule engine beside its SQL, and the driver's entry."""

import pytest

from rulewright.plans import oracle, queries

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, data, name):
    from oracle_compare import compare, connect

    assert compare(spark, connect(data), name, queries.queries()[name], oracle.oracle_sql()[name], data) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == len(queries.RULES) and set(entry.oracle_sql()) <= set(entry.queries())
