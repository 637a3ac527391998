"""Elements, table grids and the parsers over them, on hand-written pages."""

from __future__ import annotations

import datetime
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regolith.sources import elements as E
from regolith.sources import report_pages as R

RULES = [("Zinc", ["zinc"]), ("Kava", ["kava"])]


@pytest.fixture
def old(spark):
    return F.lit("2024-01-01").cast("date")


@pytest.fixture
def now(spark):
    return F.lit("2024-06-01").cast("timestamp")


def page(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page long, html string")


def texts(line):
    return [c["text"] for c in line]


def test_merged_cells_stand_at_every_place():
    cell = lambda t, down=1, across=1: (t, None, False, down, across)
    rows = [("tbody", [cell("a", 2), cell("b", 1, 2), cell("c", 3)]), ("tbody", [cell("d"), cell("e")]), ("tbody", [cell("f"), cell("g"), cell("h")]), ("tfoot", [cell("i")])]
    assert [texts(x) for x in E.grid_of(rows)] == [["a", "b", "b", "c"], ["a", "d", "e", "c"], ["f", "g", "h", "c"], ["i"]]
    assert [c["origin"] for c in E.grid_of(rows)[0]] == [True, True, False, True]
    zero = [("tbody", [cell("a", 0), cell("b")]), ("tbody", [cell("c")]), ("tbody", []), ("tfoot", [cell("d")])]
    assert [texts(x) for x in E.grid_of(zero)] == [["a", "b"], ["a", "c"], ["a"], ["d"]]
    assert E.grid_of([]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), max_size=4), max_size=5))
def test_grid_equals_painting(shape):
    rows = [("tbody", [(f"{i}.{j}", None, False, d, a) for j, (d, a) in enumerate(line)]) for i, line in enumerate(shape)]
    board = {}
    for i, line in enumerate(shape):
        at = 0
        for j, (down, across) in enumerate(line):
            while (i, at) in board:
                at += 1
            # a cell wider than the gap goes over what comes from above
            for x in range(at, at + across):
                for y in range(i, i + down):
                    board.setdefault((y, x), f"{i}.{j}")
            at += across
    if any(a > 1 for line in shape for _, a in line) and any(d > 1 for line in shape for d, _ in line):
        return  # overlaps are not defined by the markup
    want = []
    for i in range(len(shape)):
        line, at = [], 0
        while (i, at) in board:
            line.append(board[i, at])
            at += 1
        want.append(line)
    assert [texts(x) for x in E.grid_of(rows)] == want


def test_walk_closes_what_the_markup_leaves_open():
    got = E.walked("<h2>Top</h2><ul><li>one<li>two <a href=x>link</a></ul><table><tr><td>1<td>2<tr><td>3</table><p>tail <br> end")
    assert [(e["tag"], e["text"], e["under"]) for e in got] == [("h2", "Top", None), ("li", "one", 0), ("li", "two link", 0), ("a", "link", 0), ("tr", "1 2", 0), ("tr", "3", 0)]
    assert [e["pos"] for e in got] == list(range(6))
    assert E.walked(None) == [] and E.walked("") == [] and E.walked("plain < text") == []
    assert E.walked("<script>if (a < b) {'<li>x</li>'}</script><li>y")[0]["text"] == "y"


def test_first_rung_is_a_pages_own(spark):
    pages = page(spark, "<li>a</li><article>b</article>", "<li>c</li>", "<p>d</p>", None)
    got = E.climb(pages, lambda e: e["tag"] == "article", lambda e: e["tag"] == "li").select("page", "rung", "text").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "b"), (1, 1, "c")]


def test_fallbacks_need_no_exchange(spark, capsys):
    E.climb(page(spark, "<li>a"), lambda e: e["tag"] == "article", lambda e: e["tag"] == "li").explain()
    assert "Exchange" not in capsys.readouterr().out


TABLE = """<table><thead><tr><th rowspan=2>End date<th colspan=2>Firm</tr><tr><th>Name<th>Place</tr></thead><tbody>
<tr><td rowspan=2>02/03/2024<td rowspan=2><a href="/f/1">Acme</a><td>zinc lot not tested</tr><tr><td>kava record missing</tr>
<tr><th>End date<th>Firm Name<th>Firm Place</tr><tr><td>05/06/2019<td>Old<td>x</tr></tbody></table>"""
GOES_ON = "<table><tbody><tr><td>07/03/2024<td>Beta<td colspan=2>dirty <b>line</b></tr><tr><td>a<td>b</tr></tbody></table>"


def test_inspections_over_merged_cells_and_pages(spark, old):
    pages = spark.createDataFrame([("l", 0, TABLE), ("l", 1, "<p>nothing</p>"), ("l", 1002, GOES_ON), ("m", 1, None)], "listing string, page long, html string")
    got = sorted((str(r.date), r.company, r.raw_text, r.ingredient, r.url) for r in R.inspections(pages, old, RULES).collect())
    assert got == [
        ("2024-03-02", "Acme", "02/03/2024 Acme kava record missing", "Kava", "https://www.fda.gov/f/1"),
        ("2024-03-02", "Acme", "02/03/2024 Acme zinc lot not tested", "Zinc", "https://www.fda.gov/f/1"),
        ("2024-03-07", "Beta", "07/03/2024 Beta dirty line", "Unknown", "https://www.fda.gov/observations"),
    ]
    named = {(r.page, r.line): r.names for r in E.table_rows(pages).collect()}
    assert named[1002, 0] == named[0, 2] == ["End date", "Firm Name", "Firm Place"]
    assert R.inspections(pages.limit(0), old, RULES).collect() == []


def test_a_named_column_wins_over_its_place(spark, old):
    html = "<table><tr><th>No<th>Company<th>Date</tr><tbody><tr><td>7<td>Acme<td>2024-02-02</tr></tbody></table>"
    assert [(r.company, r.date) for r in R.inspections(spark.createDataFrame([("l", 0, html)], "listing string, page long, html string"), old, RULES).collect()] == [("Acme", datetime.date(2024, 2, 2))]


@pytest.mark.parametrize(
    ("inside", "date"),
    [
        ("<time datetime='2024-02-03T10:00:00'>x</time><i class='date'>2024-05-05</i>", "2024-02-03"),
        ("<time>3 March 2024</time>", "2024-03-03"),
        ("<time datetime='soon'></time><span class='post date'>2024-05-05</span>", "2024-05-05"),
        ("<b class='updated'>2024-05-05</b> on 7 june 2024 or 2024-08-08", "2024-06-07"),
        ("31 February 2024, 2024-08-08", "2024-08-08"),
        ("none", None),
    ],
)
def test_date_of_an_element(spark, inside, date):
    got = E.climb(page(spark, f"<article>{inside}</article>"), lambda e: e["tag"] == "article").select(E.stated_date().alias("d")).collect()
    assert [r.d and str(r.d) for r in got] == [date]


def test_alerts_and_recalls(spark, old):
    art = '<article><a href="/x">first</a><h3><a href="/1">Zinc ban</a></h3><p>teaser advisory</p></article><article>no link</article>'
    rows = '<div class="views-row"><a href="https://o/2">Plain notice</a><div class="date">01/02/2019</div></div><div class="views-row"><a href="/3">Kava recall</a></div>'
    got = {r.url: (r.title, r.citation_type, r.ingredient, r.severity) for r in R.safety_alerts(page(spark, art, rows, None), old, RULES).collect()}
    assert got == {"https://www.tga.gov.au/1": ("Zinc ban", "ban", "Zinc", "high"), "https://www.tga.gov.au/3": ("Kava recall", "safety_alert", "Kava", "medium")}
    got = {r.url: r.citation_type for r in R.recalls(page(spark, art, rows), old, RULES).collect()}
    assert got == {"https://www.tga.gov.au/1": "safety_alert", "https://www.tga.gov.au/3": "recall"}


def test_enforcement_records(spark, old):
    one = {"product_description": "Zinc caps", "recalling_firm": "Acme", "reason_for_recall": "salmonella", "recall_number": "F-1", "recall_initiation_date": "20240203", "classification": "Class II"}
    bodies = spark.createDataFrame([(0, json.dumps({"results": [one, one | {"classification": "Class I", "recall_number": ""}, one | {"classification": None}, one | {"recall_initiation_date": "20190101"}]})), (1, None), (2, "x")], "page long, body string")
    got = R.enforcement(bodies, old, RULES).collect()
    assert sorted(r.severity for r in got) == ["high", "high", "medium"] and {r.company for r in got} == {"Acme"} and {r.ingredient for r in got} == {"Zinc"}
    assert len({r.id for r in got}) == 2


def test_letters_from_json_else_the_table(spark, old):
    row = lambda d, name, url, subject: [f'<time datetime="{d}">x</time>', "", f'<a href="{url}">{name}</a>', "Office", subject]
    data = [row("2024-03-01", "Acme", "/l/1", "CGMP/Dietary Supplement"), row("2024-03-01", "Acme", "/l/1", "again"), row("2024-02-01", "Other", "/l/2", "Tobacco"), row("2020-01-01", "Late", "/l/3", "Vitamin"), row("2024-03-01", "After", "/l/4", "Vitamin"), ["x"]]
    bodies = spark.createDataFrame([(0, json.dumps({"data": data})), (1, None)], "page long, body string")
    html = page(spark, "<table><tr><td>2024-02-02</td><td><a href='/h'>Vitamin claims</a></td><td></td><td>Acme</td></tr></table><table><tr><td>2024-02-02</td><td>zinc vitamin</td></tr></table>", None)
    assert [(r.title, r.citation_type, r.url) for r in R.letters(bodies, html, old, RULES).collect()] == [("Acme — CGMP/Dietary Supplement", "GMP_violation", "https://www.fda.gov/l/1")]
    assert [(r.title, r.citation_type, r.company) for r in R.letters(bodies.where("page > 0"), html, old, RULES).collect()] == [("Vitamin claims", "warning_letter", "Acme")]


def test_news_and_opinions(spark, old):
    html = '<article><a href="/1">Zinc in food safety</a><p>risk</p></article><article><a href="/2">Politics of a day</a></article>'
    cards = '<li class="ecl-list__item"><h4><a href="/3">GMP inspection of kava</a></h4></li><li class="ecl-list__item"><a href="/4">short</a></li>'
    assert [r.url for r in R.food_news(page(spark, html, None), old, RULES).collect()] == ["https://www.efsa.europa.eu/1"]
    assert [(r.url, r.gmp_category != "") for r in R.medicine_news(page(spark, cards), old, RULES).collect()] == [("https://www.ema.europa.eu/3", True)]
    assert [r.ingredient for r in R.herbal_opinions(page(spark, html), old, RULES).collect()] == ["Zinc"]
    assert R.herbal_opinions(page(spark, html), old, RULES, most=0).collect() == []


WORDS = ["supplement", "kava"]


def test_consultations_by_each_rung(spark, now):
    rows = '<table><tr><th>Title</th><th>Status</th></tr><tr><td><a href="/c/1">Kava rules</a></td><td>Open</td><td>1 May 2024</td></tr></table><article><a href="/c/9">kava card</a></article>'
    cards = '<ul class="item-list"><li><a href="https://o/2">Supplement label</a> now CLOSED 3 May 2024</li></ul><ul><li><a href="/no">kava elsewhere</a></li></ul>'
    links = '<p><a href="/consultation/3">On a kava proposal</a> <a href="/4">A supplement proposal</a> <a href="/5">kava</a> <a href="/consultation/6">Unrelated proposal</a></p>'
    got = {r.url: r.body_text.split("\n")[:3] for r in R.consultations(page(spark, rows, cards, links, None, rows), WORDS, now).collect()}
    assert got == {
        "https://www.tga.gov.au/c/1": ["Consultation: Kava rules", "Status: Open", "Dates: 1 May 2024"],
        "https://o/2": ["Consultation: Supplement label", "Status: closed", "Date: 3 May 2024"],
        "https://www.tga.gov.au/consultation/3": ["Title: On a kava proposal", "URL: https://www.tga.gov.au/consultation/3"],
        "https://www.tga.gov.au/4": ["Title: A supplement proposal", "URL: https://www.tga.gov.au/4"],
    }


def test_committees(spark, now):
    table = '<table><tr><td>2 May 2024</td><td>Food</td><td>kava</td><td>zinc</td></tr><tr><td>x</td><td>Devices</td></tr></table>'
    got = R.committee_calendar(page(spark, table, '<a href="/m">Vitamin panel</a><a href="/n">Other</a>', None), now, "https://home").collect()
    assert {r.url: r.title for r in got} == {"https://home": "FDA Advisory Committee: Food", "https://www.fda.gov/m": "FDA Advisory: Vitamin panel"}
    assert "Agenda Items: kava | zinc" in next(r.body_text for r in got if r.url == "https://home")
    html = "<ul><li>kava early</li></ul><h3>Herbal panel</h3><ul><li><a href='/1'>Meeting 3–5 May 2024</a></li></ul><h3>Devices</h3><ul><li>Meeting 9 May 2024</li></ul>"
    got = {r.url: (r.title, r.body_text.split("\n")[3]) for r in R.committee_sections(page(spark, html, None), now, "https://h").collect()}
    assert got == {"https://h": ("EMA : kava early", "Date: "), "https://www.ema.europa.eu/1": ("EMA Herbal panel: Meeting 3–5 May 2024", "Date: 3–5 May 2024")}


def test_reviews_of_one_journal_and_year(spark, now, tmp_path):
    def record(i, journal="Cochrane Database Syst Rev", year="2024", month="Mar", doi="10.1/x"):
        ids = f'<ArticleId IdType="pubmed">{i}</ArticleId><ArticleId IdType="doi">{doi}</ArticleId>' if doi else '<ArticleId IdType="pubmed">1</ArticleId>'
        return (
            f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><Journal><JournalIssue><PubDate><Year>{year}</Year><Month>{month}</Month></PubDate></JournalIssue></Journal>"
            f"<ArticleTitle>Zinc {i}</ArticleTitle><AuthorList><Author><LastName>Doe</LastName><ForeName>A</ForeName></Author></AuthorList></Article><MedlineJournalInfo><MedlineTA>{journal}</MedlineTA></MedlineJournalInfo></MedlineCitation>"
            f"<PubmedData><ArticleIdList>{ids}</ArticleIdList></PubmedData></PubmedArticle>"
        )

    (tmp_path / "r.xml").write_text("<S>" + record(1) + record(1) + record(2, "Other J") + record(3, year="2023", month="Apr") + record(4, year="2023", month="05", doi="") + record(5, year="") + "</S>")
    got = {r.url.split("/")[-2]: r.body_text.split("\n") for r in R.reviews_xml(spark, f"file://{tmp_path}", F.lit("2024-05-15").cast("date"), now).collect()}
    assert sorted(got) == ["1", "4"]
    assert got["1"][2:5] == ["DOI: 10.1/x", "Authors: Doe A", "Published: 2024-Mar"] and got["4"][2] == "DOI: N/A" and got["4"][-1].startswith("See full review")


def test_very_long_pages_and_clashing_columns(spark, old):
    long = "<article><h3><a href='/1'>Zinc " + "x" * 1_000_000 + "</a></h3></article>" + "<li>" * 3000
    pages = spark.createDataFrame([(0, long, "a", "b")], "page long, html string, HTML2 string, Elements2 string")
    assert [len(r.title) for r in R.safety_alerts(pages, old, RULES).collect()] == [1_000_005]


def test_a_worker_holds_the_elements_of_few_pages():
    html = "<article><h3><a href='/1'>Zinc</a></h3></article>" * 1000
    pages = pa.RecordBatch.from_pydict({"page": list(range(50)), "html": [None, *[html] * 49]})
    out = list(E._walk_with(["page"])(iter([pages])))
    assert max(x.num_rows for x in out) <= 7 and [p for x in out for p in x.column("page").to_pylist()] == list(range(50))
    assert [len(e) for x in out for e in x.column("elements").to_pylist()] == [0, *[3000] * 49]
    assert list(E._walk_with(["page"])(iter([pages.slice(0, 0)]))) == []
