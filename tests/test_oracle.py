"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from tests.oracle import compare, duck, entry_mod

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry_mod.queries()))
def test_query(spark, con, name):
    status, rows, note = compare(spark, con, name, SF)
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "label" in df.columns
