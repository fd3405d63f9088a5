import pytest

import oracle
from corvane.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert oracle.differ(df, SQL[name], con) is None
    else:
        assert df.count() > 0
