"""Listings, XML, preprints, retail pages and sinks on hand-written inputs."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regolith.operators import display, sinks
from regolith.sources import listings as L
from regolith.sources.batches import rows_of_pages


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


HTML = """<h2>Alerts</h2><ul><li><a href="/a/1">First safety alert</a><time datetime="2024-01-20T00:00:00Z">x</time></li>
<li><a href="b/2">Second notice here</a><span class="pub-date">3 January 2024</span></li><li><a href="https://o/3">Third undated notice</a></li>
<li><a href="/a/4">Fourth old notice</a> on 2 March 2020</li><li><a href="/a/1">First safety alert</a></li><li><a href="/x">nav</a></li></ul>
<h3>Updates</h3><table><tr><td><a href="/u/5">Fifth update text</a></td><td>2024-01-09</td></tr></table>"""


def test_listing(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None)], "page_id long, html string")
    got = {r.href: (r.date and str(r.date), r.section) for r in L.html_listing(pages).where("pos <> 4").collect()}
    assert got["/a/1"] == ("2024-01-20", "Alerts") and got["b/2"] == ("2024-01-03", "Alerts")
    assert got["https://o/3"] == (None, "Alerts") and got["/a/4"] == ("2020-03-02", "Alerts") and got["/u/5"] == ("2024-01-09", "Updates")
    out = L.listing_notices(pages, "tga", "https://base", F.lit("2024-01-01").cast("date"), now()).collect()
    assert {r.url for r in out} == {"https://base/a/1", "https://base/b/2", "https://o/3", "https://base/u/5"}


def test_literature_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Jan</Month></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>On zinc</ArticleTitle>"
        "<Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>A</ForeName></Author><Author><ForeName>x</ForeName></Author></AuthorList></Article></MedlineCitation></PubmedArticle></Set>"
    )
    r = L.literature_xml(spark, str(tmp_path / "p.xml"), now()).first()
    assert (r.url, r.title) == ("https://pubmed.ncbi.nlm.nih.gov/7/", "On zinc")
    assert "Authors: Doe A\n" in r.body_text and "Publication Date: 2024-Jan" in r.body_text and r.body_text.endswith("One. Two.")


def test_preprints_and_products(spark):
    body = json.dumps({"collection": [{"doi": "10.1/a", "title": "Vitamin trial"}, {"doi": "10.1/b", "title": "Rocks"}]})
    assert [r.url for r in L.preprints_json(spark.createDataFrame([("s", 0, body)], "server string, page int, body string"), ["vitamin"], now()).collect()] == ["https://doi.org/10.1/a"]
    item = {"@type": "Product", "sku": "9", "name": "Fish oil", "brand": {"name": "Co"}, "offers": {"price": "13.99"}, "description": "<p>Good</p>"}
    html = f'<script type="application/ld+json">{json.dumps(item)}</script>'
    r = L.product_pages(spark.createDataFrame([(1, "u1", html), (2, "u2", html)], "page_id long, url string, html string"), now()).collect()
    assert [(x.url, x.title, x.body_text) for x in r] == [("u1", "Fish oil", "Brand: Co\nPrice: AU$13.99\nGood")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "FDA", 1), ("b", "TGA", 2)], "id string, authority string, n int")
    sinks.write_citations(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    assert sinks.fingerprint(rows).first() == sinks.fingerprint(rows.orderBy(F.desc("id")).repartition(3)).first()
    assert sinks.fingerprint(rows).first().fingerprint != sinks.fingerprint(rows.withColumn("n", F.lit(1))).first().fingerprint
    merged = sinks.merge_sample(rows, rows.where("id = 'a'").withColumn("n", F.lit(9)))
    assert sorted((r.id, r.n) for r in merged.collect()) == [("a", 9), ("b", 2)]
    counts = spark.createDataFrame([(3, 2, 1, 0)], "total int, correct int, incorrect int, partially_correct int")
    for _ in range(2):
        sinks.append_accuracy(counts, str(tmp_path / "acc"), "2024-01-31")
    got = spark.read.option("header", True).csv(str(tmp_path / "acc")).collect()
    assert [r.pct for r in got] == ["66.7", "66.7"]
    sinks.append_feedback(rows, str(tmp_path / "t"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert sinks.data_block(rows, rows).first().signals == 2


@pytest.mark.parametrize("raw,want", [("acme LABS llc", "Acme Labs LLC"), ("house OF herbs inc", "House of Herbs Inc."), ("x d/b/a y co.", "X d/b/a Y Co."), ("(us) foods, ltd", "(US) Foods, Ltd."), ("", ""), (None, "")])
def test_entity_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(display.entity_name(F.col("r")).alias("n")).first().n == want


def test_snippet(spark):
    cases = ["Intro text. You failed to clean (b)(4)  lines. Next One. More.", "Dear Sir, hello there", "Start here. A violation was seen.", "plain"]
    got = [r.s for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", display.violation_snippet(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == ["You failed to clean [redacted] lines. Next One. More.", "Dear Sir, hello there", "A violation was seen.", "plain"]


def test_a_worker_holds_the_rows_of_few_pages():
    html = "<li><a href='/a'>One</a></li>" * 5000
    walk = rows_of_pages(L._blocks, [(n, pa.string()) for n in ("href", "title", "text", "time_attr", "date_text", "section")])
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(20)), "html": [html] * 19 + [None]})
    out = list(walk(iter([pages])))
    assert max(x.num_rows for x in out) <= 10_000 and sum(x.num_rows for x in out) == 95_000
    assert out[0].slice(1, 1).to_pylist() == [{"page_id": 0, "pos": 1, "href": "/a", "title": "One", "text": "One", "time_attr": None, "date_text": None, "section": None}]
