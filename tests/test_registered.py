"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle import compare, connect
from plumbline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        same, note = compare(frame, con, ORACLES[name])
        assert same, note
    else:
        assert frame.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
