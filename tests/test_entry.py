import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark, sf_dir):
    assert e.entry(spark).count() > 0
