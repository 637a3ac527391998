"""Registered queries of the page parsers with fallbacks, over pages captured from the test tables.

Pages of one query have several layouts, so that every fallback is taken; the statements state the
results from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import store as S
from ..sources import elements as E
from ..sources import report_pages as W
from . import oracle as O
from .catalog import on_citations
from .catalog_sources import PER_PAGE, captured, cutoff, day, joined

RULES = [("Sildenafil", ["sildenafil"]), ("NDMA", ["ndma"])]
SINCE = "1995-06-01"
KEYWORDS = ["recall", "batch", "failure"]
RAW = f"with {O.values(R.REPORT_CATEGORY, 'repr')}, raw as (select *, trim(regexp_replace(coalesce(company, ''), '\\s+', ' ', 'g')) as firm from ({O.citations_sql()}))"
PAGE = f"(rec_no // {PER_PAGE})"
IN_TIME = f"(date is null or date >= date '{SINCE}')"
CATEGORY = "coalesce((select label from repr where contains(lower(txt), phrase) order by ord limit 1), '')"
HIGH = "|".join(x.replace(".", r"\.") for x in R.REPORT_HIGH)
SHOWN = ["title", "url", "ingredient", "citation_type", "severity", "company", "gmp_category"]


def shown(d: DataFrame) -> DataFrame:
    return d.select(*SHOWN, F.date_format("date", "yyyy-MM-dd").alias("date"))


def report(rows: str, category: str = "''", severity: str | None = None) -> str:
    """From (title, url, citation_type, date, company, txt)."""
    severity = severity or (
        f"case when regexp_matches(lower(txt), '{HIGH}') then 'high' when citation_type in ('ban', 'recall') and regexp_matches(lower(txt), 'class i|serious|life') then 'high'"
        f" when citation_type in ('warning_letter', 'GMP_violation', 'recall') then 'medium' when regexp_matches(lower(txt), '{'|'.join(R.REPORT_LOW)}') then 'low' else 'medium' end"
    )
    return (
        f"{RAW}, x as ({rows}) select title, url, case when contains(lower(txt), 'sildenafil') then 'Sildenafil' when contains(lower(txt), 'ndma') then 'NDMA' else 'Unknown' end as ingredient,"
        f" citation_type, {severity} as severity, company, {category} as gmp_category, strftime(date, '%Y-%m-%d') as date from x"
    )


def by_page(*layouts: Column) -> Column:
    """The layout of a row's page, in turn."""
    out = F
    for i, x in enumerate(layouts):
        out = out.when(F.floor(F.col("rec_no") / PER_PAGE) % len(layouts) == i, x)
    return out


def dated() -> Column:
    """A date stated in each of the four ways."""
    k = F.col("rec_no") % 4
    return (
        F.when(k == 0, joined('<time datetime="', day(), '">stated</time>'))
        .when(k == 1, joined("<i class='post date'>", day("d MMMM yyyy"), "</i>"))
        .when(k == 2, joined("<b>on ", day("d MMMM yyyy"), "</b>"))
        .otherwise(joined("<b>at ", day(), "</b>"))
    )


def _cards(c: DataFrame, teaser: Column, heading: str = "h3", card: str = "views-row") -> DataFrame:
    inner = joined(f'<a href="/more"><img src=x></a><{heading}><a href="/a/', F.col("rec_no"), '">', F.col("summary"), f"</a></{heading}><p>", teaser, "</p>", dated())
    return captured(c, by_page(joined("<article>", inner, "</article>"), joined(f"<div class='x {card}'>", inner, "</div>")))


_PARTS = "summary as title, '{base}/a/' || rec_no as url, date, '' as company"


def _parts(base: str) -> str:
    return _PARTS.replace("{base}", base)


on_citations("msc36_stated_date", f"{RAW} select rec_no, strftime(date, '%Y-%m-%d') as date from raw where {PAGE} % 2 = 0")(
    lambda c: E.once(E.climb(_cards(c, F.lit("x")), lambda e: e["tag"] == "article"), date=E.stated_date()).select(F.regexp_extract("head_href", r"(\d+)$", 1).cast("long").alias("rec_no"), F.date_format("date", "yyyy-MM-dd").alias("date"))
)
on_citations("src29_safety_alerts", report(f"select {_parts('https://www.tga.gov.au')}, summary || ' ' || firm as txt, case when contains(lower(summary), 'ban') then 'ban' else 'safety_alert' end as citation_type from raw where {IN_TIME}"))(
    lambda c: shown(W.safety_alerts(_cards(c, F.col("company")), cutoff(SINCE), RULES))
)
_NOTE = "case when rec_no % 3 = 0 then 'An advisory' else 'A note' end"
on_citations(
    "src29_recalls",
    report(f"select {_parts('https://www.tga.gov.au')}, summary || ' ' || {_NOTE} as txt, case when contains(lower(summary), 'recall') then 'recall' when rec_no % 3 = 0 or contains(lower(summary), 'advisory') then 'safety_alert' else 'recall' end as citation_type from raw where {IN_TIME}"),
)(lambda c: shown(W.recalls(_cards(c, F.when(F.col("rec_no") % 3 == 0, "An advisory").otherwise("A note")), cutoff(SINCE), RULES)))

_FOOD = "case when rec_no % 5 = 0 then 'On a vitamin' else 'On a day' end"
on_citations("src29_food_news", report(f"select summary as title, 'https://www.efsa.europa.eu/a/' || rec_no as url, date, '' as company, summary || ' ' || {_FOOD} as txt, 'safety_alert' as citation_type from raw where {IN_TIME} and {O.rx(f'(summary || {_FOOD})', W.FOOD_TERMS)}"))(
    lambda c: shown(W.food_news(captured(c, by_page(*[joined(f"<{a}><a href='/a/", F.col("rec_no"), "'>", F.col("summary"), "</a><p>", F.when(F.col("rec_no") % 5 == 0, "On a vitamin").otherwise("On a day"), "</p>", dated(), f"</{b}>") for a, b in (("article", "article"), ("div class='listing__item'", "div"), ("li class='node--type-news'", "li"))])), cutoff(SINCE), RULES))
)
_MED = f"coalesce(nullif({CATEGORY}, ''), case when contains(upper(txt), 'GMP') then '{W.NON_COMPLIANT}' else '' end)"
on_citations(
    "src29_medicine_news",
    report(
        f"select * exclude (k), case when k <> '' then 'GMP_violation' else 'inspection_finding' end as citation_type from (select *, {_MED} as k from (select {_parts('https://www.ema.europa.eu')}, summary || ' A note' as txt from raw where {IN_TIME} and length(summary) >= 10 and {O.rx('summary', W.MEDICINE_TERMS)}))",
        _MED,
    ),
)(lambda c: shown(W.medicine_news(_cards(c, F.lit("A note"), "h4", "ecl-content-item"), cutoff(SINCE), RULES)))


def _actions(c: DataFrame) -> DataFrame:
    of = F.element_at(F.array(F.lit("Class I"), F.lit("Class II"), F.lit(None)), (F.col("rec_no") % 3 + 1).cast("int"))
    rec = F.struct(F.col("company").alias("product_description"), F.col("company").alias("recalling_firm"), F.col("summary").alias("reason_for_recall"), F.concat(F.lit("F-"), "rec_no").alias("recall_number"), day("yyyyMMdd").alias("recall_initiation_date"), of.alias("classification"))
    return captured(c, F.to_json(rec), '{"results": [', "]}", ",", "body")


on_citations(
    "src29_enforcement",
    report(
        f"select company as title, 'https://www.accessdata.fda.gov/scripts/ires/?action=RecallAction&RecallNumber=F-' || rec_no as url, 'recall' as citation_type, date, company, company || ' ' || summary as txt, rec_no from raw where {IN_TIME}",
        severity=f"case rec_no % 3 when 0 then 'high' when 1 then 'medium' else case when regexp_matches(lower(txt), '{HIGH}|class i|serious|life') then 'high' else 'medium' end end",
    ),
)(lambda c: shown(W.enforcement(_actions(c), cutoff(SINCE), RULES)))


def _letter_pages(c: DataFrame) -> DataFrame:
    cells = [joined('<time datetime="', day(), '">x</time>'), F.lit(""), joined('<a href="', F.col("url"), '">', F.col("company"), "</a>"), F.lit("Office"), F.when(F.col("rec_no") % 2 == 0, F.col("summary")).otherwise(joined("Dietary Supplement/", F.col("summary")))]
    return captured(c, F.to_json(F.array(*cells)), '{"data": [', "]}", ",", "body")


_SUBJECT = "case when rec_no % 2 = 0 then summary else 'Dietary Supplement/' || summary end"
on_citations(
    "src29_letters",
    report(
        f"""select substr(company || ' — ' || subject, 1, 200) as title, url, company, date, txt, case when contains(upper(subject), 'GMP') or {CATEGORY} <> '' then 'GMP_violation' else 'warning_letter' end as citation_type
  from (select *, subject || ' ' || company || ' Office' as txt from (select rec_no, url, firm as company, date, {_SUBJECT} as subject from raw
   where rec_no < coalesce((select min(rec_no) from raw where date < date '1995-01-03'), 1000000000000)) qualify row_number() over (partition by url order by rec_no) = 1)
  where {O.rx('txt', W.LETTER_SUBJECT + '|' + W.LETTER_TERMS)}""",
        CATEGORY,
    ),
)(lambda c: shown(W.letters(_letter_pages(c), captured(c.where("false"), F.lit("")), cutoff("1995-01-03"), RULES)))


def _observations(c: DataFrame) -> DataFrame:
    """Two rows share the merged cells of their firm and date; the heading stands on the first page alone."""
    pair = c.groupBy(F.floor(F.col("rec_no") / 2).alias("k")).agg(F.min("rec_no").alias("rec_no"), F.min_by("company", "rec_no").alias("company"), F.min_by("date", "rec_no").alias("date"), F.array_sort(F.collect_list(F.struct("rec_no", "summary"))).alias("s"))
    merged = lambda x: joined("<td rowspan=", F.size("s"), ">", x, "</td>")
    first = joined("<tr><td>", F.get("s", 0)["summary"], "</td>", merged(F.col("company")), merged(day()), "</tr>")
    rest = F.when(F.size("s") > 1, joined("<tr><td>", F.get("s", 1)["summary"], "</tr>"))
    pages = captured(pair, joined(first, rest), "<tbody>", "</tbody></table>")
    head = F.when(F.col("page") == 0, "<table><thead><tr><th>Observation<th colspan=2>Inspection</tr><tr><th><th>Firm<th>Date</tr></thead>").otherwise("<table>")
    return pages.select(F.lit("observations").alias("listing"), "page", F.concat(head, "html").alias("html"))


on_citations(
    "src29_inspections",
    report(
        f"""select substr(txt, 1, 150) as title, 'https://www.fda.gov/observations' as url, 'inspection_finding' as citation_type, date, company, txt from (
  select company, date, concat_ws(' ', summary, nullif(company, ''), strftime(date, '%Y-%m-%d')) as txt from (
   select summary, first_value(firm) over w as company, first_value(date) over w as date from raw window w as (partition by rec_no // 2 order by rec_no)) where {IN_TIME})""",
        f"coalesce(nullif({CATEGORY}, ''), '{W.NON_COMPLIANT}')",
    ),
)(lambda c: shown(W.inspections(_observations(c), cutoff(SINCE), RULES)))


def _raw(d: DataFrame) -> DataFrame:
    return d.select("url", "title", "body_text")


def _consultations(c: DataFrame) -> DataFrame:
    named = lambda path: joined(f'<a href="/{path}/', F.col("rec_no"), '">', F.col("summary"), "</a>")
    table = joined("<table><tr><td>", named("c"), "</td><td>Open</td><td>", day(), "</td></tr></table>")
    item = joined("<ul class='item-list'><li>", named("c"), " closed ", day("d MMM yyyy"), "</li></ul>")
    link = F.when(F.col("rec_no") % 2 == 0, named("Consultation")).otherwise(named("c"))
    return captured(c, by_page(table, item, link))


_WORD = f"'{'|'.join(KEYWORDS)}'"
_CARD_TEXT = "summary || ' closed' || coalesce(' ' || strftime(date, '%-d %b %Y'), '')"
on_citations(
    "src08_consultations",
    f"""{RAW}, x as (select rec_no, summary, date, {PAGE} % 3 as rung, 'https://www.tga.gov.au/' || case when {PAGE} % 3 = 2 and rec_no % 2 = 0 then 'Consultation/' else 'c/' end || rec_no as url from raw),
 y as (select url, summary as title, case rung when 0 then 'Consultation: ' || summary || chr(10) || 'Status: Open' || chr(10) || 'Dates: ' || coalesce(strftime(date, '%Y-%m-%d'), '') || chr(10) || 'URL: ' || url
   when 1 then 'Consultation: ' || summary || chr(10) || 'Status: ' || case when contains(lower(summary), 'open') then 'open' else 'closed' end || chr(10) || 'Date: ' || coalesce(strftime(date, '%-d %b %Y'), '') || chr(10) || 'Context: ' || {_CARD_TEXT} || chr(10) || 'URL: ' || url
   else 'Title: ' || summary || chr(10) || 'URL: ' || url end as body_text from x where rung < 2 or (length(summary) >= 15 and (rec_no % 2 = 0 or regexp_matches(lower(summary), {_WORD}))))
 select * from y where regexp_matches(lower(title || ' ' || body_text), {_WORD})""",
)(lambda c: _raw(W.consultations(_consultations(c), KEYWORDS, F.current_timestamp())))

_CALENDAR = "Source: FDA Advisory Committee Calendar"
on_citations(
    "src09_calendar",
    f"""{RAW}, x as (select *, 'https://www.fda.gov/m/' || rec_no as u from raw where regexp_matches(lower(summary), {_WORD}))
 select u as url, case when {PAGE} % 2 = 0 then 'FDA Advisory Committee: ' || firm else 'FDA Advisory: ' || summary end as title, '{_CALENDAR}' || chr(10) || case when {PAGE} % 2 = 0 then
  'Committee: ' || firm || chr(10) || 'Meeting Date: ' || coalesce(strftime(date, '%Y-%m-%d'), '') || chr(10) || 'Agenda Items: ' || summary || ' | x' else 'Agenda Item: ' || summary end || chr(10) || 'URL: ' || u as body_text from x""",
)(
    lambda c: _raw(
        W.committee_calendar(
            captured(c, by_page(joined("<table><tr><td>", day(), "<td>", F.col("company"), "<td><a href='/m/", F.col("rec_no"), "'>", F.col("summary"), "</a><td>x</tr></table>"), joined("<p><a href='/m/", F.col("rec_no"), "'>", F.col("summary"), "</a></p>"))),
            F.current_timestamp(), "https://home", keywords=KEYWORDS,
        )
    )
)
on_citations(
    "src09_sections",
    f"""{RAW}, x as (select *, 'https://www.ema.europa.eu/s/' || rec_no as u, concat_ws(' ', nullif(firm, ''), strftime(date, '%-d %B %Y')) as t from raw where regexp_matches(lower(summary), {_WORD}))
 select u as url, 'EMA ' || summary || ': ' || substr(t, 1, 100) as title, 'Source: EMA Committee Meeting Calendar' || chr(10) || 'Committee: ' || summary || chr(10) || 'Meeting: ' || t || chr(10) || 'Date: ' || coalesce(strftime(date, '%-d %B %Y'), '') || chr(10) || 'URL: ' || u as body_text from x where t <> ''""",
)(
    lambda c: _raw(
        W.committee_sections(
            captured(c, joined("<h3>", F.col("summary"), "</h3>", by_page(joined("<ul><li><a href='/s/", F.col("rec_no"), "'>", F.col("company"), "</a> ", day("d MMMM yyyy"), "</ul>"), joined("<table><tr><td><a href='/s/", F.col("rec_no"), "'>", F.col("company"), "</a><td>", day("d MMMM yyyy"), "</table>")))),
            F.current_timestamp(), "https://home", keywords=KEYWORDS,
        )
    )
)


def _reviews(c: DataFrame) -> DataFrame:
    journal = F.when(F.col("rec_no") % 3 == 0, "Other J").otherwise(W.REVIEW_JOURNAL)
    month = F.when(F.col("rec_no") % 2 == 0, day("MMM")).otherwise(day("MM"))
    doi = F.when(F.col("rec_no") % 5 > 0, joined('<ArticleId IdType="doi">10.1/', F.col("rec_no"), "</ArticleId>"))
    record = joined(
        "<PubmedArticle><MedlineCitation><PMID>", F.col("rec_no"), "</PMID><Article><Journal><JournalIssue><PubDate><Year>", day("yyyy"), "</Year><Month>", month, "</Month></PubDate></JournalIssue></Journal><ArticleTitle>",
        F.col("summary"), "</ArticleTitle><AuthorList><Author><LastName>Doe</LastName><ForeName>", F.col("company"), "</ForeName></Author></AuthorList></Article><MedlineJournalInfo><MedlineTA>", journal,
        '</MedlineTA></MedlineJournalInfo></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId>', doi, "</ArticleIdList></PubmedData></PubmedArticle>",
    )
    path = S.shared_path(c.sparkSession, "reviews")
    captured(c, record, "<Set>", "</Set>").select("html").write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return _raw(W.reviews_xml(c.sparkSession, path, cutoff("1996-03-15"), F.current_timestamp()))


on_citations(
    "src12_reviews",
    f"""{RAW} select 'https://pubmed.ncbi.nlm.nih.gov/' || rec_no || '/' as url, summary as title, '[COCHRANE SYSTEMATIC REVIEW]' || chr(10) || 'PMID: ' || rec_no || chr(10) || 'DOI: ' || case when rec_no % 5 > 0 then '10.1/' || rec_no else 'N/A' end || chr(10) || 'Authors: Doe' || coalesce(' ' || nullif(firm, ''), '') || chr(10)
  || 'Published: ' || case when rec_no % 2 = 0 then strftime(date, '%Y-%b') else strftime(date, '%Y-%m') end || chr(10) || chr(10) || 'Abstract:' || chr(10) || 'See full review at Cochrane Library.' as body_text
 from raw where rec_no % 3 > 0 and last_day(date) >= date '1996-03-15' - 365""",
)(_reviews)
