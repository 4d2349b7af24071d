"""Every registered query that SQL can say, against its SQL twin; the others must run and give rows."""

import os

import pytest
import twins

from visilake.registry import registered

SF = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES = registered()

@pytest.fixture(scope="module")
def con():
    return twins.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    build, sql = QUERIES[name]
    if sql is None:
        assert build(spark, SF).count() > 0
        return
    mine, theirs, differences = twins.compare(spark, con, SF, build, sql)
    assert (mine, differences) == (theirs, [])
