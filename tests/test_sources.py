"""Parsers, enrichment, rules and streams on small hand-written inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from regolith.functions import expr as X
from regolith.operators import alerts, citations, enrich, facets, rollups, store
from regolith.sources import parsers as P
from regolith.streaming import ingest as I



def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def test_adverse_event_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Product,Reactions,OUTCOME,Date\nFish Oil,rash,ok,2024-01-02\n,none,,\nSteel bar,dent,,\nVitamin C,vitamin nausea,bad,\n")
    got = P.adverse_event_csv(P.read_csv(spark, str(tmp_path / "a.csv")), "caers", "http://x", ["vitamin", "fish oil"], now()).orderBy("title").collect()
    assert [r.title for r in got] == ["Adverse Event: Fish Oil", "Adverse Event: Vitamin C"]
    assert "Outcome: ok" in got[0].body_text and len(got[0].source_id) == 16


def test_recall_pages_stop_at_the_first_old_row(spark):
    row = lambda d, b, k="dietary supplement": [f"<b>{d}</b>", f'<a href="/r/{b}">{b}</a>', "Pill &amp; cap", k, "why", "Co", "", ""]
    pages = [(0, json.dumps({"data": [row("01/20/2024", "A"), row("01/19/2024", "B", "drug")]})), (1, json.dumps({"data": [row("01/10/2023", "C"), row("01/18/2024", "D")]}))]
    got = P.recall_pages(spark.createDataFrame(pages, "page int, body string"), "https://base", ["dietary supplement"], F.lit("2024-01-01").cast("date"), now()).collect()
    assert [(r.title, r.url) for r in got] == [("A — Pill & cap", "https://base/r/A")]


def test_literature_prefers_one_address(spark):
    body = json.dumps({"resultList": {"result": [{"pmid": "1", "doi": "d", "title": "T."}, {"pmid": "1", "title": "again"}, {"doi": "10.1/x", "title": "U"}, {"pmcid": "P", "title": "V"}, {"title": "W x"}, {"title": ""}]}})
    got = {r.title: r.url for r in P.literature_json(spark.createDataFrame([(0, body)], "page int, body string"), now()).collect()}
    assert got == {"T": "https://pubmed.ncbi.nlm.nih.gov/1/", "U": "https://doi.org/10.1/x", "V": "https://europepmc.org/article/PMC/P", "W x": "https://europepmc.org/search#query=W+x"}


def test_trials_registry_sitemap(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "Trial"}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Big Vitamins"}}, "designModule": {"phases": ["2", "3"]}}}
    r = P.trials_json(spark.createDataFrame([(json.dumps({"studies": [study]}),)], "body string"), ["big vitamins"], now()).first()
    assert r.competitive and "Phase: 2, 3" in r.body_text and "Interventions: See study" in r.body_text
    ids = P.registry_ids(spark.createDataFrame([("ACTRN123 ISRCTN9 ACTRN123",)], "html string"), now())
    assert {x.title for x in ids.collect()} == {"WHO ICTRP Trial: ACTRN123", "WHO ICTRP Trial: ISRCTN9"}
    maps = spark.createDataFrame([("<loc>http://s/buy/12/vitamin-c</loc><loc>http://s/buy/99/vitamin-d</loc><loc>http://s/buy/5/soap</loc>",)], "body string")
    assert [x.product_id for x in P.sitemap_urls(maps, ["vitamin"]).collect()] == [99, 12]


def test_enforcement_records(spark):
    recs = [{"product_description": "sterile vial", "recalling_firm": "Co", "reason_for_recall": "sterility", "recall_number": "Z-1", "recall_initiation_date": "20240105", "classification": "Class I"}, {"product_description": "bar", "recall_initiation_date": "20200101"}]
    got = P.enforcement_json(spark.createDataFrame([("http://q", json.dumps({"results": recs}))], "url string, body string"), "drug", "General Pharma", F.lit("2023-01-01").cast("date")).collect()
    assert len(got) == 1 and (got[0].severity, got[0].facility_type, str(got[0].date)) == ("high", "Sterile / Parenteral", "2024-01-05") and got[0].url.endswith("RecallNumber=Z-1")


def test_watchlist(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"query_suffix": "safety", "ingredients": ["zinc", "_note", "iron safety"]}))
    assert [r.query for r in P.watchlist_queries(spark, str(tmp_path / "w.json")).orderBy("ord").collect()] == ["zinc safety", "iron safety"]


def test_links(spark):
    pages = spark.createDataFrame([(1, '<nav><a href="/news/1">Home</a></nav><a href="/news/2">A long <b>notice</b> title</a><a>none</a>'), (2, None)], "page_id long, html string")
    assert [(r.pos, r.href, r.text) for r in P.html_links(pages).collect()] == [(0, "/news/1", "Home"), (1, "/news/2", "A long notice title")]
    assert [r.href for r in P.hub_links(P.html_links(pages), "^/news/", ["home"]).collect()] == ["/news/2"]


@pytest.mark.parametrize("text,first,want", [("2024-03-05T10:00:00Z", False, "2024-03-05"), ("03/04/2024", False, "2024-04-03"), ("03/04/2024", True, "2024-03-04"), ("5 March 2024", False, "2024-03-05"), ("Mar 5, 2024", False, "2024-03-05"), ("25/12/2024", True, "2024-12-25"), ("20240305", False, "2024-03-05"), ("soon", False, None), ("", False, None)])
def test_dates(spark, text, first, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.parse_date("t", first).alias("d")).first().d
    assert (got and str(got)) == want


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"rule_name": "a", "trigger_type": "severity_threshold", "filters": {"min_severity": "high"}, "channels": ["email", "chat"], "frequency": "instant"}, {"trigger_type": "nothing", "filters": {}}]))
    rules = alerts.load_rules(spark, str(tmp_path / "r.json"))
    assert (rules[0].min_severity, rules[0].channels, rules[1].name, rules[1].min_spike_ratio) == ("high", ("email", "chat"), "Unnamed rule", 2.0)


def test_salvage_and_failures(spark):
    rows = spark.createDataFrame([(1, 'x {"sentiment": "positive", "confidence": 7} y'), (2, "no json"), (3, '{"sentiment": "odd"}')], "id int, answer string")
    got = {r.id: (r.sentiment, r.sentiment_confidence) for r in enrich.sentiment_answers(rows, "id").collect()}
    assert got == {1: ("positive", 1.0), 2: ("neutral", 0.0), 3: ("neutral", 0.0)}


def test_priority_table(spark):
    base = dict(summary="", violation_details="", enriched_text="", enrichment_status="", source_type="recall", severity="", company="", facility_type="General Pharma", authority="FDA", url="", id="x", date=None, classification_confidence=0.0, decision_summary="")
    cases = [
        (dict(summary="class i recall"), "P1"), (dict(source_type="drug_enforcement", summary="class ii lot, calibration overdue"), "P2"), (dict(source_type="warning_letter", summary="note"), "P3"),
        (dict(source_type="warning_letter", summary="class i recall", authority="FDA"), "P1"), (dict(source_type="warning_letter", summary="calibration overdue"), "P2"),
        (dict(source_type="warning_letter", summary="calibration overdue", authority="TGA"), "P1"), (dict(source_type="guidance", summary="training"), "P3"), (dict(source_type="guidance", summary="zzz"), "P4"),
    ]
    rows = spark.createDataFrame([tuple((base | c).values()) + (i,) for i, (c, _) in enumerate(cases)], "summary string, violation_details string, enriched_text string, enrichment_status string, source_type string, severity string, company string, facility_type string, authority string, url string, id string, date date, classification_confidence double, decision_summary string, n int")
    got = [r.priority for r in citations.priority(citations.classified(rows)).orderBy("n").collect()]
    assert got == [p for _, p in cases]


def test_priorities_fall_in_the_caps_and_clusters_have_one_primary(spark):
    from regolith.plans import views

    c = citations.recurrence(citations.priority(citations.classified(views.citations(spark, "/root/testdata/sf0.001"))), views.CITATIONS_AS_OF).select("*", F.col("priority").alias("before"))
    c = spark.read.parquet(store.write_shared(c, "invariant"))
    out = citations.clusters(citations.trust_cap(citations.low_detail_cap(c))).cache()
    assert out.where("priority < before").count() == 0
    assert out.where("cluster_id is not null").groupBy("cluster_id").agg(F.sum(F.col("cluster_primary").cast("int")).alias("p")).where("p <> 1").count() == 0
    assert out.where("cluster_primary").agg(F.sum("cluster_size")).first()[0] == out.count()
    assert out.where(F.array_contains("secondary_gmp_categories", F.col("primary_gmp_category"))).count() == 0


def test_insert_is_idempotent(spark):
    table = spark.createDataFrame([("a", 1)], "source_id string, rec_no int")
    rows = spark.createDataFrame([("b", 3), ("b", 2), ("a", 9)], "source_id string, rec_no int")
    once = store.insert_or_ignore(table, rows)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]
    assert store.insert_new(once, rows).count() == 0
    assert store.accuracy(spark.createDataFrame([], "rating string")).first().total == 0


def test_stream_ingest_and_windows(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(f"k{i % 7}", i, "Zinc", f"2024-01-{1 + i % 20:02d} 00:00:00") for i in range(60)], "source_id string, rec_no int, ingredient_name string, t string").selectExpr("source_id", "rec_no", "ingredient_name", "cast(t as timestamp_ntz) as scraped_at")
    rows.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    I.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 7 == out.select("source_id").distinct().count()
    I.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7

    q = I.rolling_counts(spark.readStream.schema(rows.schema).parquet(str(src))).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {(str(r.start), r.n) for r in spark.sql("select * from rolled").collect()}
    batch = {(str(r.start), r.n) for r in I.rolling_counts(rows).collect()}
    assert closed and closed <= batch


def test_labels(spark):
    d = spark.createDataFrame([(300, 10, 0), (12, 6, 3), (3, 0, 0)], "n int, h int, p int")
    got = d.select(rollups.volume_bucket(F.col("n")).alias("v"), rollups.risk_impact(F.col("n"), F.col("h")).alias("r"), rollups.movement(F.col("h"), F.col("p")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("Very High", "Critical", "new this period"), ("Low", "Critical", "+3 vs prior"), ("Minimal", "Watch", "")]
    assert facets.Facets().priority == "all"
