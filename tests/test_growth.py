"""Steps whose cost once grew faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from regolith.operators import citations, facets, overview
from regolith.plans import catalog

ROWS = "rec_no long, id string, cluster_id string, cluster_primary boolean, severity string"
DATA = [(1, "a", "x", False, "low"), (2, "b", "x", True, "high"), (3, "c", "x", False, "low"), (4, "d", None, True, "low"), (5, "e", "y", False, "low"), (6, "f", "y", False, "high")]


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString(), d._jdf.queryExecution().sparkPlan().toString()


def test_classification_does_not_follow_row_groups(spark):
    logical, _ = plan(catalog.QUERIES["prj10_multi_label"](spark, "/root/testdata/sf0.001"))
    assert "RepartitionByExpression [rec_no" in logical


def test_a_collapsed_row_is_found_without_sorting_rows(spark):
    c = spark.createDataFrame(DATA, ROWS)
    d = facets.collapse(c)
    assert sorted((r.rec_no, r.other_members) for r in d.collect()) == [(2, 2), (4, 0), (5, 1)] and d.columns == [*c.columns, "other_members"]
    assert "SortAggregate" not in plan(d)[1] and "SortMergeJoin" not in plan(d)[1]
    by = overview.collapse_by(c, "severity")
    assert sorted((r.severity, r.rec_no) for r in by.collect()) == [("high", 2), ("high", 6), ("low", 1), ("low", 4), ("low", 5)] and by.columns == c.columns


def test_wide_rows_meet_cluster_figures_unsorted(spark):
    base = catalog.citations(spark, "/root/testdata/sf0.001")
    c = base.withColumns({"primary_gmp_category": F.lit("a"), "failure_mode": F.lit("b"), "regulatory_severity": F.lit("high"), "priority": F.lit("P2")})
    joined = citations.clusters(citations.recurrence(c, "2001-08-01"))
    assert plan(joined)[1].count("ShuffledHashJoin") >= 2
