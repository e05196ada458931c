"""Every registered query of the core over the smallest tables, against its SQL where it has one."""

import pytest

from evenfold.plans import core, problems
from tests.compare import check

QUERIES = core.QUERIES | problems.QUERIES
ORACLE = core.ORACLE | problems.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE.get(name))


def test_entry_registers_all():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()


def test_core_needs_no_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['evenfold.llm'] = None; import __spark_entry__ as e; assert 'reduce_documents' in e.queries() and 'p8_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0
