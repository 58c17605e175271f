"""Every query of the library's core against its SQL on the smallest tables."""

import pytest

from conftest import DATA
from termforge.plans import problems, reference

SQL = reference.oracle_sql() | problems.oracle_sql()
QUERIES = reference.queries() | problems.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    got = oracle.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(tuple, got.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == want


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, DATA).count() > 0
