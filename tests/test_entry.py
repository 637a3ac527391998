"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["ingredient", "count_7d", "count_30d"] and df.count() > 0


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
