import pytest

from millrace.plans import pipeline
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(pipeline.QUERIES))
def test_query_equals_oracle(spark, name):
    compare(spark, pipeline.QUERIES[name], pipeline.SQL[name], FOLDER)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(pipeline.QUERIES) <= set(e.queries())
