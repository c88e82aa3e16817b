import __spark_entry__ as e


def test_names_and_sql():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert "reconcile_scores" in q


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0
