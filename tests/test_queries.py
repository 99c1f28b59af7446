"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import checks.catalog  # noqa: F401
from checks.compare import compare
from checks.registry import ORACLE, QUERIES
from __spark_entry__ import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    status, n, _, note = compare(spark, SF, name, QUERIES[name], ORACLE.get(name))
    assert status in ("ok", "rows"), f"{status}: {note}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_entry(spark):
    assert entry(spark).count() > 0
