import os

import pytest

import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 57
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship(spark):
    assert not entry.entry(spark).isEmpty()
