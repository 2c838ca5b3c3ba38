"""The driver's contract."""

import __spark_entry__ as entry


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["seed", "module", "n"]
