import sys

import pytest
from oracle_check import ROOT, check

sys.path.insert(0, str(ROOT))
import __spark_entry__ as entry  # noqa: E402
from memgov.plans import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, data, name):
    assert check(spark, data, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["writer_id", "outcome", "requests"]
