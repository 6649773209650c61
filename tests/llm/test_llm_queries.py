import os

import pytest

from scoria.llm import queries
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_others_run(spark, name):
    assert queries.queries()[name](spark, DATA).count() >= 0
