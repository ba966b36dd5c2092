import pytest

from shardline.llm import queries
from tests.conftest import SF_CHECK
from tests.oracle_compare import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF_CHECK).toPandas()
    problems = [p for p in compare(got, duck(SF_CHECK).execute(queries.ORACLE[name]).df()) if not p.startswith("dtype")]
    assert not problems, problems
