"""Every registered reference query equals its SQL statement on the small folder."""

import pytest

from adlattice.plans import boards, reference, requests  # noqa: F401  boards and requests add their queries
from tests.oracle import connect, rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_same_rows_as_sql(spark, con, name):
    cols, got = rows_of(reference.QUERIES[name](spark, FOLDER))
    names, want = sql_rows(con, reference.SQL[name])
    assert cols == names
    assert got == want
