"""Every registered text query over the smallest tables, against its SQL where it has one."""

import pytest

from evenfold.llm import queries
from tests.compare import check


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    check(spark, sf, queries.QUERIES[name], queries.ORACLE.get(name))
