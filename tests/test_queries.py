"""Every registered query against its check SQL, on the smallest tables."""

import pytest
from compare import compare, connect

from workload.queries import REGISTERED

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [name for name, (_, check) in REGISTERED.items() if check]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_check(spark, con, name):
    run, check = REGISTERED[name]
    problem, rows = compare(spark, con, SF_DIR, run, check)
    assert problem is None
    assert rows > 0


def test_entry_runs(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"repo", "rank", "node_id", "degree"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
