import pytest

from millrace import llm
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_oracle(spark, name):
    compare(spark, llm.queries()[name], llm.oracle_sql()[name], "/root/testdata/sf0.001")


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
