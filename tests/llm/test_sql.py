import pytest

from pairlens.llm.queries import QUERIES, SQL
from tests.verify import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op2_near_duplicates", "op3_near_vectors", "op10_decontamination"])
def test_like_sql(spark, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) == ""
