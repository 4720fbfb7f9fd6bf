"""Every registered query against its SQL, on whole tables of the smallest scale."""

import os

import pytest
from oracle import compare, duck

from postmeter.workloads import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok is not False, note
