"""Audit reports by grouping sets: one scan, ties, salts, empty tables, files."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from regolith.operators import audit as U

COLUMNS = "id string, company string, product_type string, authority string, source_type string, priority string, failure_mode string, primary_gmp_category string, regulatory_pressure string, enrichment_status string, cluster_id string, cluster_size long, cluster_primary boolean, cluster_label string, cluster_priority string, date date, regulatory_severity string, operational_severity string, inspection_risk string, market_relevance_au string"


def citations(spark, n):
    rows = spark.range(n).selectExpr(
        "lpad(cast(id as string), 5, '0') as id", "if(id % 5 = 0, '', concat('co', id % 300)) as company", "'tablet' as product_type", "concat('A', id % 2) as authority", "'recall' as source_type", "concat('P', 1 + id % 4) as priority",
        "if(id % 3 = 0, '', concat('mode', id % 7)) as failure_mode", "if(id = 4, '', concat('cat', id % 40)) as primary_gmp_category", "'stable' as regulatory_pressure", "if(id % 2 = 0, 'cached', '') as enrichment_status", "if(id % 10 < 9, concat('k', id % 900), null) as cluster_id",
        "if(id % 10 < 9, 2L, 1L) as cluster_size", "id < 900 as cluster_primary", "'label' as cluster_label", "'P1' as cluster_priority", "date_add(date'2024-01-01', cast(id % 50 as int)) as date", "'high' as regulatory_severity", "'high' as operational_severity", "if(id = 7, null, 'standard') as inspection_risk", "'direct' as market_relevance_au",
    )
    return spark.createDataFrame(rows.rdd, COLUMNS)


def test_one_scan_and_totals_over_salts(spark, tmp_path):
    c = citations(spark, 2000)
    c.write.parquet(f"{tmp_path}/c")
    stored = spark.read.parquet(f"{tmp_path}/c")
    report = U.enrichment_audit(stored, "2024-02-01")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan parquet", plan.split("Initial Plan")[-1])) == 1
    r = report.first()
    rows = c.collect()
    clusters = {}
    for x in rows:
        if x.cluster_id:
            clusters.setdefault(x.cluster_id, []).append(x.priority)
    assert r.total_citations == 2000 and r.data_quality.missing_required_intelligence_fields_count == 2
    assert r.clustering.total_clusters == len(clusters) and r.clustering.grouped_records_count == sum(map(len, clusters.values()))
    assert r.clustering.p1_clusters == sum("P1" in p for p in clusters.values())
    assert r.clustering.p2_clusters == sum("P2" in p and "P1" not in p for p in clusters.values())
    want = sorted(((-len(p), k) for k, p in clusters.items()))[:10]
    assert [(-x.size, x.cluster_id) for x in r.clustering.top_10_clusters] == want
    assert list(r.top_categories.items()) == [(k, 50) for k in sorted(f"cat{i}" for i in range(40) if i != 4)][:10]
    assert r.enrichment.cached == 1000 and r.enrichment.success == 0 and r.ai_pass.import_error is None
    assert len(r.p1p2_clusters) == 20 and r.p1p2_clusters[0].entity_label == "tablet"


def test_empty_table_and_missing_columns(spark):
    r = U.enrichment_audit(citations(spark, 0).drop("ai_summary"), "2024-02-01", ["tga", "fda"], import_error="none there").first()
    assert r.total_citations == 0 and r.priority_breakdown == {} and r.p1p2_clusters == [] and r.failed_sources == ["tga", "fda"]
    assert r.clustering.total_clusters == 0 and r.ai_pass.import_error == "none there"


def test_written_as_json(spark, tmp_path):
    U.write_report(U.enrichment_audit(citations(spark, 50), "2024-02-01", calls={"accepted": 3, "discarded": 1}), f"{tmp_path}/r")
    (line,) = spark.read.text(f"{tmp_path}/r").collect()
    got = json.loads(line.value)
    assert got["total_citations"] == 50 and got["ai_call_tracking"] == {"accepted": 3, "discarded": 1} and got["ai_pass"]["import_error"] is None
    assert got["data_quality"]["ai_results_accepted_count"] == 3


def test_sections_need_different_keys(spark):
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    try:
        U.sectioned(rows, {"x": U.Section(("k",)), "y": U.Section(("k",))}, [F.count("*").alias("n")])
    except ValueError as e:
        assert "same keys" in str(e)
    else:
        raise AssertionError
