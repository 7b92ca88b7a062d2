"""Every registered query outside the training-data subpackage against its SQL."""

import pytest

from loomgraph.plans import answers, catalogue, core, feeds, graphs, tables  # noqa: F401
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    if name not in catalogue.ORACLES:
        assert df.count() >= 0
        return
    assert differences(df, catalogue.ORACLES[name], con) == ""
