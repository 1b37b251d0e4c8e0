import pytest
from compare import compare, connect
from conftest import SF_DIR

from sealdex.plans.oracle import oracle_sql
from sealdex.plans.queries import QUERIES

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_oracle(spark, tables, name):
    matches, _, _, difference = compare(spark, tables, SF_DIR, QUERIES[name], ORACLE[name])
    assert matches, difference


def test_entry_point(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_staged_by_a_column_reads_one_folder_a_value(spark):
    from sealdex.plans.queries import _having, _staged_by

    rows = [(i, v) for i, v in enumerate(["a", "", None, "b=/c", "a", None, " a", "é"])]
    stored = _staged_by(spark.createDataFrame(rows, "id int, source string"), "source", "by-source")
    for value in {v for _, v in rows}:
        found = _having(stored, "source", value)
        assert found.columns == ["id", "source"]
        assert sorted(r.id for r in found.collect()) == [i for i, v in rows if v == value]
        assert "PartitionFilters: [isnotnull(slot" in found._jdf.queryExecution().executedPlan().toString()
