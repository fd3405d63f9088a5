import pytest

import oracle
from corvane.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_or_runs_whole(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert oracle.differ(df, SQL[name], oracle.connect(sf_dir)) is None
    else:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        assert df.select("doc_id").distinct().count() == docs.count()
