import pytest

from haulmark.plans.catalog import ORACLES, QUERIES
from tests.oracle import connect, same

MAY_BE_EMPTY = set()


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def data(request):
    d = f"/root/testdata/sf{request.param}"
    return d, connect(d)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    d, con = data
    rows = same(QUERIES[name](spark, d), con, ORACLES[name])
    assert rows or name in MAY_BE_EMPTY or "0.001" in d


def test_every_query_is_sql_or_known():
    assert set(QUERIES) - set(ORACLES) <= {"breaker_sim"}
