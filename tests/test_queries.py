import pytest

from compare import differences
from kithgraph import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert not differences(spark, registry.queries()[name], registry.oracle_sql()[name], FOLDER)


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
