import os

import pytest

import __spark_entry__ as entry
from scoria.plans import catalogue
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    assert compare(catalogue.queries()[name](spark, DATA), con, catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_others_run(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
