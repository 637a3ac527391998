"""Agency parsers, store readers and overview helpers on hand-written inputs."""

from __future__ import annotations

import datetime
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from regolith.operators import overview as V
from regolith.operators import store as S
from regolith.operators.facets import Facets
from regolith.operators.trends import claim_shift
from regolith.sources import agencies as G


def since(text="2024-01-01"):
    return F.lit(text).cast("date")


def letter(day, name, url):
    return [day, "", f'<a href="{url}">{name}</a>', "office", f"CGMP / {name}", "", "", "batch record missing"]


def test_letters_stop_at_the_first_old_one(spark):
    pages = [(0, json.dumps({"data": [letter("02/01/2024", "One", "/l/1"), letter("01/20/2024", "Two", "https://x/2"), letter("", "Undated", "/l/3")]})), (1, json.dumps({"data": [letter("12/31/2020", "Old", "/l/4"), letter("02/02/2024", "After", "/l/5")]})), (2, None), (3, "no json")]
    bodies = spark.createDataFrame(pages, "page long, body string")
    table = spark.createDataFrame([(0, "<table><tr><td>02/01/2024</td><td></td><td><a href='/h/1'>Html</a></td><td>o</td><td>Subject</td></tr><tr><td>short</td></tr></table>"), (1, None)], "page long, html string")
    got = {r.company: (r.url, r.date and str(r.date)) for r in G.warning_letters(bodies, table, since()).collect()}
    assert got == {"One": ("https://www.fda.gov/l/1", "2024-02-01"), "Two": ("https://x/2", "2024-01-20"), "Undated": ("https://www.fda.gov/l/3", None)}
    fallback = G.warning_letters(bodies.where("page > 1"), table, since()).collect()
    assert [(r.company, r.summary, r.url) for r in fallback] == [("Html", "Subject", "https://www.fda.gov/h/1")]
    assert G.warning_letters(bodies.limit(0), table.limit(0), since()).collect() == []


def test_import_alert_prefix_names_the_facility(spark):
    row = lambda n, d, name, link="": f"<tr><td>{n}</td><td>DWPE</td><td>{d}</td><td>{name}{link}</td></tr>"
    html = "<table><tr><th>No</th></tr>" + row("89-01", "05/02/2024", "Detention", '<a href="i1.html"></a>') + row("12-01", "05/02/2024", "Other") + row("66-40", "05/02/2019", "Old") + row("57-02", "", "Blood") + "</table>"
    got = {r.violation_details: (r.url, r.facility_type, r.product_type) for r in G.import_alerts(spark.createDataFrame([(0, html)], "page long, html string"), since(), "https://b").collect()}
    assert got == {"89-01 Detention": ("https://b/i1.html", "Supplement / Nutraceutical", "Import Alert DWPE"), "57-02 Blood": ("https://b/ialist.html", "Biologics / Vaccine", "Import Alert DWPE")}


def test_market_actions_skip_the_first_article_and_undated_links(spark):
    art = lambda t, u, time='<time datetime="2024-02-02">x</time>', p="": f'<article><h2><a href="{u}">{t}</a></h2>{time}{p}</article>'
    html = art("Menu", "/m") + art("Recall of zinc", "/1", p="<p>Recalled by Acme Foods, see below</p>") + art("Untimed", "/2", time="") + art("Safety advisory", "/3") + art("Plain", "/4") + art("Recall of zinc", "/1")
    got = {r.url: (r.source_type, r.company) for r in G.market_actions(spark.createDataFrame([(0, html, "compliance_action")], "page long, html string, default_type string"), since(), "https://t").collect()}
    assert got == {"https://t/1": ("recall", "Acme Foods, see below"), "https://t/3": ("safety_alert", ""), "https://t/4": ("compliance_action", "")}


def test_store_reader_takes_the_first_document_that_exists(spark, tmp_path):
    one = tmp_path / "b.json"
    one.write_text(json.dumps({"citations": [{"id": "x", "authority": "FDA", "date": "2024-01-02", "summary": "s"}], "meta": 1}))
    got = G.read_citation_store(spark, f"file://{tmp_path}/absent.json", f"file://{one}").collect()
    assert [(r.id, r.authority, r.date, r.url) for r in got] == [("x", "FDA", datetime.date(2024, 1, 2), None)]
    assert G.read_citation_store(spark, f"file://{tmp_path}/none.json").collect() == []


def test_sections_and_files(spark):
    pages = spark.createDataFrame([(1, "<p>short recall</p><p>A longer text about a Recall here.</p><li>nothing to see in this item</li><a href='/d/x.CSV'>d</a><a href='y.html'>e</a>"), (2, None)], "page long, html string")
    assert [r.text for r in G.page_sections(pages, ["recall"]).collect()] == ["A longer text about a Recall here."]
    assert [r.url for r in G.data_files(pages, "https://x").collect()] == ["https://x/d/x.CSV"]


def test_focus_and_chips():
    assert V.focus_facets("category", "x") == Facets(category="x") and V.focus_facets("odd", "x") == Facets() == V.focus_facets(None)
    assert V.active_chips(Facets(authority="FDA", di_capa=True)) == [("authority", "FDA"), ("di_capa", "True")]


def test_shared_path_of_a_cluster_session_must_be_named(spark):
    assert S.shared_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    assert S.shared_path(session("local[2]"), "x").startswith("file:///")
    with pytest.raises(ValueError):
        S.shared_path(session("spark://h:1"), "x")


def test_claim_shift_is_the_same_for_any_partitions(spark):
    base = datetime.datetime(2024, 1, 20)
    rows = [(i, f"herb {i % 3}", "efficacy_claim" if i < 40 else "safety_concern", "other", base + datetime.timedelta(seconds=(i // 4) * (3600 if i % 2 else 1))) for i in range(81)]
    s = spark.createDataFrame(rows, "rec_no long, ingredient_name string, signal_type string, event_type string, scraped_at timestamp_ntz")
    want = sorted(map(tuple, claim_shift(s.coalesce(1), "2024-01-31 00:00:00").collect()))
    assert want == sorted(map(tuple, claim_shift(s.repartition(7), "2024-01-31 00:00:00").collect()))
    late = {r[0]: k >= len(rows) // 2 for k, r in enumerate(sorted(rows, key=lambda r: (r[4], r[0])))}
    for name, before, after, n_before, n_after, total in want:
        mine = [r for r in rows if r[1] == name]
        assert total == len(mine)
        assert n_before == sum(r[2] == before and not late[r[0]] for r in mine) and n_after == sum(r[2] == after and late[r[0]] for r in mine)
    assert want
    assert claim_shift(s.limit(0), "2024-01-31 00:00:00").collect() == []
