"""Registered queries of the source parsers, over bodies captured from the test tables.

Each query first writes the rows into the markup or JSON that an agency serves and then parses it;
its statement states the result from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import store as S
from ..sources import agencies as G
from ..sources import listings as L
from ..sources import parsers as P
from ..sources import registers as N
from . import oracle as O
from .catalog import QUERIES, SQL, on_citations, on_signals
from .views import tables

PER_PAGE = 200
OLD = "1995-01-03"


def captured(c: DataFrame, block: Column, before: str = "<html>", after: str = "</html>", glue: str = "\n", name: str = "html", per: int = PER_PAGE) -> DataFrame:
    """(page, body): ``per`` consecutive numbers a page, in their order."""
    rows = c.select(F.floor(F.col("rec_no") / per).cast("long").alias("page"), F.struct("rec_no", block.alias("b")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), glue)
    return rows.groupBy("page").agg(F.concat(F.lit(before), body, F.lit(after)).alias(name))


def joined(*parts: Column | str) -> Column:
    """Texts and columns in a row; null is empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def day(fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format("date", fmt)


def shown(d: DataFrame) -> DataFrame:
    return d.select("url", "company", F.date_format("date", "yyyy-MM-dd").alias("date"), "source_type", "category", "severity", "facility_type", "summary", "product_type")


def category(x: str) -> str:
    return f"coalesce((select label from catr where contains(lower({x}), phrase) order by ord limit 1), 'GMP violations')"


def facility(x: str) -> str:
    return f"coalesce((select label from facr where contains(lower({x}), phrase) order by ord limit 1), 'General Pharma')"


def severity(x: str, kind: str) -> str:
    return f"case when {O.rx(x, R.HIGH)} or {O.class_one(x)} then 'high' when {kind} in {O.in_list(R.MEDIUM_TYPES)} then 'medium' when {O.rx(x, R.LOW)} then 'low' else 'medium' end"


def expected(rows: str, judged: str = "source_type", place: str | None = None) -> str:
    """From (rec_no, url, company, date, source_type, txt, summary, product_type), first of each address."""
    place = place or facility("txt")
    return (
        f"{O.CIT}, x as ({rows}), y as (select * from x qualify row_number() over (partition by url order by rec_no) = 1) select url, company, strftime(date, '%Y-%m-%d') as date, source_type,"
        f" {category('txt')} as category, {severity('txt', judged)} as severity, {place} as facility_type, substr(summary, 1, 300) as summary, product_type from y"
    )


def cutoff(text: str = OLD) -> Column:
    return F.lit(text).cast("date")


AFTER_OLD = f"rec_no < coalesce((select min(rec_no) from raw where date < date '{OLD}'), 1000000000000)"
def _letter_cells() -> list[Column]:
    return [day("MM/dd/yyyy"), F.lit("x"), joined('<a href="', F.col("url"), '">', F.col("company"), "</a>"), F.lit("office"), F.col("summary"), F.lit(""), F.lit(""), F.col("violation_details")]


_LETTERS = expected(
    f"select rec_no, url, trim(regexp_replace(company, '\\s+', ' ', 'g')) as company, date, 'warning_letter' as source_type, concat_ws(' ', nullif(summary, ''), nullif(trim(company), ''), nullif(violation_details, '')) as txt, summary, 'FDA Warning Letter' as product_type from raw where {AFTER_OLD}"
)


def _letter_table(c: DataFrame) -> DataFrame:
    return captured(c, joined("<tr>", *[x for cell in _letter_cells() for x in ("<td>", cell, "</td>")], "</tr>"), "<table>", "</table>")


def _letter_pages(c: DataFrame) -> DataFrame:
    cells = F.to_json(F.array(*[F.coalesce(x, F.lit("")) for x in _letter_cells()]))
    return captured(c, cells, '{"data": [', "]}", ",", "body")


on_citations("src22_warning_letters", _LETTERS)(lambda c: shown(G.warning_letters(_letter_pages(c), _letter_table(c.where("false")), cutoff())))
on_citations("src22_letters_table", _LETTERS)(lambda c: shown(G.warning_letters(_letter_pages(c.where("false")), _letter_table(c), cutoff())))

_NUMBER = "(case rec_no % 8 when 0 then '56-' when 1 then '57-' when 2 then '63-' when 3 then '66-' when 4 then '88-' when 5 then '89-' when 6 then '99-' else '45-' end || lpad(cast(rec_no as varchar), 9, '0'))"


def _import_alerts(c: DataFrame) -> DataFrame:
    number = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("56-", "57-", "63-", "66-", "88-", "89-", "99-", "45-")]), (F.col("rec_no") % 8 + 1).cast("int")), F.lpad(F.col("rec_no").cast("string"), 9, "0"))
    link = F.when(F.col("rec_no") % 3 < 2, joined('<a href="importalert_', F.col("rec_no"), '.html">more</a>')).otherwise("")
    row = joined("<tr><td>", number, "</td><td>DWPE</td><td>", day("dd/MM/yyyy"), "</td><td> ", F.col("summary"), " ", link, "</td></tr>")
    return shown(G.import_alerts(captured(c, row, "<table><tr><th>Number</th></tr>", "</table>"), cutoff("1995-06-01"), "https://ia"))


_IA_NAME = "(summary || case when rec_no % 3 < 2 then ' more' else '' end)"
on_citations(
    "src24_import_alerts",
    f"""{O.CIT}, x as (select rec_no, {_NUMBER} as number, case when rec_no % 3 < 2 then 'https://ia/importalert_' || rec_no || '.html' else 'https://ia/ialist.html' end as url, date, {_IA_NAME} as summary, {_NUMBER} || ' ' || {_IA_NAME} as txt from raw where rec_no % 8 < 7 and (date is null or date >= date '1995-06-01')),
 y as (select *, {facility('txt')} as f from x)
 select url, '' as company, strftime(date, '%Y-%m-%d') as date, 'import_alert' as source_type, {category('txt')} as category, {severity('txt', "'import_alert'")} as severity,
  case when f <> 'General Pharma' then f when number like '57-%' then 'Biologics / Vaccine' when number like '89-%' then 'Supplement / Nutraceutical' when number like '63-%' then 'Medical Device' else f end as facility_type, summary, 'Import Alert DWPE' as product_type from y""",
)(_import_alerts)


def _market_actions(c: DataFrame) -> DataFrame:
    title = F.when(F.col("rec_no") % 3 == 0, joined("Recall ", F.col("rec_no"))).when(F.col("rec_no") % 3 == 1, joined("Advisory ", F.col("rec_no"))).otherwise(joined("Notice ", F.col("rec_no")))
    teaser = F.when(F.col("rec_no") % 5 == 0, "").otherwise(joined("<p>", F.col("summary"), " issued to ", F.col("company"), "</p>"))
    block = joined('<article class="a"><h3><a href="/m/', F.col("rec_no"), '">', title, '</a></h3><time datetime="', day(), '">x</time>', teaser, "</article>")
    pages = captured(c, block).withColumn("default_type", F.when(F.col("page") % 2 == 0, "compliance_action").otherwise("safety_alert"))
    return shown(G.market_actions(pages, cutoff("1995-06-01"), "https://tga"))


on_citations(
    "src25_market_actions",
    expected(
        f"""select rec_no, 'https://tga/m/' || rec_no as url, trim(regexp_extract(txt, '{G.COMPANY}', 1)) as company, date, source_type, txt, coalesce(nullif(teaser, ''), title) as summary, 'Therapeutic Good (AU)' as product_type from (
  select *, title || ' ' || teaser as txt, case rec_no % 3 when 0 then 'recall' when 1 then 'safety_alert' else case when (rec_no // {PER_PAGE}) % 2 = 0 then 'compliance_action' else 'safety_alert' end end as source_type from (
   select rec_no, date, row_number() over (partition by rec_no // {PER_PAGE} order by rec_no) as k, case rec_no % 3 when 0 then 'Recall ' when 1 then 'Advisory ' else 'Notice ' end || rec_no as title,
    case when rec_no % 5 = 0 then '' else trim(regexp_replace(summary || ' issued to ' || company, '\\s+', ' ', 'g')) end as teaser from raw) where k > 1 and (date is null or date >= date '1995-06-01'))"""
    ),
)(_market_actions)


def _safety_updates(c: DataFrame) -> DataFrame:
    path = F.substring_index("url", "example.test", -1)
    block = joined('<li class="gem-c-document-list__item"><a href="', path, '">', F.col("summary"), '</a> <time datetime="', day(), '">x</time>', F.when(F.col("rec_no") % 2 == 0, joined("<p>", F.col("violation_details"), "</p>")), "</li>")
    updates = captured(c.where("authority = 'MHRA'"), block)
    more = captured(c.where("authority = 'EFSA'"), block).withColumn("default_type", F.when(F.col("page") % 2 == 0, "inspection_finding").otherwise("compliance_action"))
    return shown(G.safety_updates(updates, more, cutoff(), "https://example.test"))


_UK = "select rec_no, url, date, txt, coalesce(nullif(teaser, ''), summary) as summary, source_type, judged, product_type, '' as company from"
_TXT = "summary || ' ' || case when rec_no % 2 = 0 then violation_details else '' end"
on_citations(
    "src26_safety_updates",
    expected(
        f"""{_UK} (select *, {_TXT} as txt, case when rec_no % 2 = 0 then violation_details else '' end as teaser, 'compliance_action' as judged, 'Medicine / Supplement (UK)' as product_type from (select * exclude (product_type) replace ('compliance_action' as source_type) from raw where authority = 'MHRA' and rec_no < coalesce((select min(rec_no) from raw where authority = 'MHRA' and date < date '{OLD}'), 1000000000000))) where {O.rx('txt', G.MHRA_TERMS)}
 union all {_UK} (select * exclude (source_type, product_type), {_TXT} as txt, case when rec_no % 2 = 0 then violation_details else '' end as teaser, case when (rec_no // {PER_PAGE}) % 2 = 0 then 'inspection_finding' else 'compliance_action' end as judged,
   case when (rec_no // {PER_PAGE}) % 2 = 0 and (contains(url, '/guidance/') or {O.rx(f'({_TXT})', R.GUIDANCE_TITLE)}) and not {O.rx(f'({_TXT})', R.ENFORCEMENT_SIGNAL)} then 'guidance' when (rec_no // {PER_PAGE}) % 2 = 0 then 'inspection_finding' else 'compliance_action' end as source_type, 'Medicine / GMP (UK)' as product_type from raw where authority = 'EFSA' and (date is null or date >= date '{OLD}'))""",
        "judged",
    ),
)(_safety_updates)

_EFSA_KINDS = ("Scientific Opinion", "News", "Guidance", "Technical Report", "Brochure")


def _pick(kinds: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("rec_no") % len(kinds) + 1).cast("int"))


def _publications(c: DataFrame) -> DataFrame:
    block = joined('<div class="views-row x"><span>', _pick(_EFSA_KINDS), '</span> <a href="', F.col("url"), '">', F.col("summary"), "</a> <i>", day("d MMMM yyyy"), "</i></div>")
    return shown(G.publications(captured(c, block), cutoff()))


_PLACE = "(['Scientific Opinion', 'News', 'Guidance', 'Technical Report', 'Brochure'])[rec_no % 5 + 1]"
on_citations(
    "src27_publications",
    expected(
        f"""select *, '' as company from (select rec_no, url, date, summary, summary || ' ' || substr(trim(kind || ' ' || summary || ' ' || coalesce(strftime(date, '%-d %B %Y'), '')), 1, 400) as txt, case kind when 'News' then 'compliance_action' when 'Guidance' then 'guidance' else 'scientific_opinion' end as source_type,
   'EFSA ' || case kind when 'Brochure' then 'Scientific Output' else kind end as product_type from (select *  exclude (source_type, product_type), {_PLACE} as kind from raw where {AFTER_OLD})) where {O.rx('txt', G.EFSA_TERMS)}""",
        place="'Supplement / Nutraceutical'",
    ),
)(_publications)

_BFR_KINDS = ("Press release", "Opinion", "Guidance", "Report")


def _assessments(c: DataFrame) -> DataFrame:
    dated = F.when(F.col("rec_no") % 2 == 0, joined('<time datetime="', day(), '">stated</time>')).otherwise(joined(day("dd/MM/yyyy")))
    block = joined('<article><a href="', F.col("url"), '">Read ', F.col("summary"), "</a> ", dated, " Category ", _pick(_BFR_KINDS), " 7</article>")
    return shown(G.assessments(captured(c, block), cutoff("1995-06-01")))


on_citations(
    "src28_assessments",
    expected(
        f"""select * from (select rec_no, url, '' as company, date, summary, summary || ' ' || substr('Read ' || summary || ' ' || case when rec_no % 2 = 0 then 'stated' else coalesce(strftime(date, '%d/%m/%Y'), '') end || case when rec_no % 2 = 1 and date is null then '' else ' ' end || 'Category ' || kind || ' 7', 1, 400) as txt,
   case kind when 'Press release' then 'compliance_action' when 'Guidance' then 'guidance' else 'scientific_opinion' end as source_type, 'Food Supplement / Food Safety (DE)' as product_type
   from (select * exclude (source_type, product_type), (['Press release', 'Opinion', 'Guidance', 'Report'])[rec_no % 4 + 1] as kind from raw) where date is null or date >= date '1995-06-01') where {O.rx('txt', G.BFR_TERMS)}"""
    ),
)(_assessments)

def _section() -> Column:
    return joined("<h2>", F.col("company"), "</h2><p>", F.col("summary"), '</p><li><a href="/f/', F.col("rec_no"), F.when(F.col("rec_no") % 3 == 0, ".CSV").otherwise(".html"), '">file</a></li>')


on_citations("msc37_sections", f"{O.CIT} select summary as text, count(*) as n from raw where length(summary) between 20 and 1000 and regexp_matches(lower(summary), 'recall|batch|failure') group by 1")(
    lambda c: G.page_sections(captured(c, _section()), ["recall", "Batch", "failure"]).groupBy("text").agg(F.count("*").alias("n"))
)
on_citations("msc37_data_files", f"{O.CIT} select 'https://x/f/' || rec_no || '.CSV' as url from raw where rec_no % 3 = 0")(lambda c: G.data_files(captured(c, _section()), "https://x").select("url"))


def _composite(s: DataFrame) -> DataFrame:
    one = s.select(F.md5("url").alias("source_id"), "authority", "severity")
    return G.relevant_composite([one.where("authority = 'tga'").distinct(), one.where("authority = 'fda'").distinct()], F.col("severity")).groupBy("relevance").agg(F.count("*").alias("n"))


on_signals("src21_composite", f"{O.SIG}, d as (select url, authority, min(severity) as severity, count(distinct severity) as k from s where authority in ('tga', 'fda') group by 1, 2), f as (select * from d qualify row_number() over (partition by url order by authority desc) = 1) select severity as relevance, count(*) as n from f where severity in ('high', 'medium') group by 1")(
    lambda s: _composite(s.groupBy("url", "authority").agg(F.min("severity").alias("severity")))
)


def _store(c: DataFrame) -> DataFrame:
    rows = c.select("rec_no", F.struct("id", "authority", "source_type", "company", day().alias("date"), F.lit("").alias("category"), "severity", "summary", "url", "product_type", "facility_type").alias("r"))
    docs = rows.groupBy(F.floor(F.col("rec_no") / 10_000).alias("page")).agg(F.to_json(F.struct(F.collect_list("r").alias("citations"))).alias("value")).select("value")
    path = S.shared_path(c.sparkSession, "store")
    docs.write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return G.read_citation_store(c.sparkSession, path + "-absent", path).select("id", "authority", F.date_format("date", "yyyy-MM-dd").alias("date"), "severity", "summary")


on_citations("src30_citation_store", f"{O.CIT} select id, authority, strftime(date, '%Y-%m-%d') as date, severity, summary from raw")(_store)
on_signals("src31_table_scan", f"{O.SIG} select source_id, authority, severity from s")(lambda s: G.read_table(s.sparkSession, S.write_shared(s, "signals"), "source_id", "authority", "severity"))

# ---- the first product's parsers ----------------------------------------------------------


def now() -> Column:
    return F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")


RAW = ("source_id", "url", "title", "body_text")


def _sid(authority: str, key: str) -> str:
    return f"substr(sha256('{authority}::' || {key}), 1, 16)"


def _recalls(c: DataFrame) -> DataFrame:
    cells = [day("MM/dd/yyyy"), joined('<a href="', F.col("url"), '">', F.col("company"), "</a>"), F.col("summary"), F.col("product_type"), F.lit("why"), F.col("authority"), F.lit(""), F.lit("")]
    pages = captured(c, F.to_json(F.array(*[F.coalesce(x, F.lit("")) for x in cells])), '{"data": [', "]}", ",", "body")
    return P.recall_pages(pages, "https://r", ["capsule", "tablet"], cutoff(), now()).select(*RAW)


_CO = "trim(regexp_replace(company, '\\s+', ' ', 'g'))"
on_citations(
    "src04_recall_pages",
    f"""{O.CIT}, k as (select * from raw where product_type in ('capsule', 'tablet')), f as (select * from k where rec_no < coalesce((select min(rec_no) from k where date < date '{OLD}'), 1000000000000))
 select {_sid('fda', 'url')} as source_id, url, case when {_CO} <> '' then {_CO} || ' — ' || summary else summary end as title, 'Published: ' || coalesce(strftime(date, '%Y-%m-%d'), 'unknown date') || chr(10) || 'Product type: ' || product_type || chr(10) || 'Reason: why' || chr(10) || 'Company: ' || authority as body_text from f""",
)(_recalls)


def _listing(c: DataFrame) -> DataFrame:
    block = joined('<li><a href="/n/', F.col("rec_no"), '">', F.col("summary"), "</a> <time datetime=\"", day(), '">t</time></li>')
    pages = captured(c, block).withColumnRenamed("page", "page_id")
    return L.listing_notices(pages, "tga", "https://b", cutoff("1995-06-01"), now(), ["recall", "failure"]).select("source_id", "url", "title")


on_citations("src02_listing", f"{O.CIT} select {_sid('tga', chr(39) + 'https://b/n/' + chr(39) + ' || rec_no')} as source_id, 'https://b/n/' || rec_no as url, summary as title from raw where (date is null or date >= date '1995-06-01') and length(summary) >= 10 and regexp_matches(lower(summary), 'recall|failure')")(_listing)


def _literature(c: DataFrame) -> DataFrame:
    r = F.to_json(F.struct(F.when(F.col("rec_no") % 3 == 0, F.col("rec_no").cast("string")).alias("pmid"), F.when(F.col("rec_no") % 3 == 1, joined("10.1/", F.col("rec_no"))).alias("doi"), joined("PMC", F.col("rec_no")).alias("pmcid"), joined(F.col("summary"), "..").alias("title"), F.col("company").alias("authorString"), day().alias("firstPublicationDate")))
    return P.literature_json(captured(c, r, '{"resultList": {"result": [', "]}}", ",", "body"), now()).select("source_id", "url", "title")


_PAPER = "case rec_no % 3 when 0 then 'https://pubmed.ncbi.nlm.nih.gov/' || rec_no || '/' when 1 then 'https://doi.org/10.1/' || rec_no else 'https://europepmc.org/article/PMC/PMC' || rec_no end"
on_citations("src11_literature_json", f"{O.CIT} select {_sid('europe_pmc', '(' + _PAPER + ')')} as source_id, {_PAPER} as url, summary as title from raw")(_literature)


def _trials(c: DataFrame) -> DataFrame:
    r = F.to_json(F.struct(F.struct(
        F.struct(joined("NCT", F.col("rec_no")).alias("nctId"), F.when(F.col("rec_no") % 4 > 0, F.col("summary")).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.struct(F.col("company").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
    ).alias("protocolSection")))
    return P.trials_json(captured(c, r, '{"studies": [', "]}", ",", "body"), ["Entity 1"], now()).select("url", "title", "competitive")


on_citations("src13_trials_json", f"{O.CIT} select 'https://clinicaltrials.gov/study/NCT' || rec_no as url, case when rec_no % 4 > 0 then summary else 'Trial NCT' || rec_no end as title, contains(lower(company), 'entity 1') as competitive from raw")(_trials)
on_citations("src14_registry_ids", f"{O.CIT}, k as (select rec_no, row_number() over (partition by rec_no // 20 order by rec_no) as k from raw) select 'https://trialsearch.who.int/Trial2.aspx?TrialID=ACTRN' || rec_no as url, 'WHO ICTRP Trial: ACTRN' || rec_no as title from k where k <= 8")(
    lambda c: P.registry_ids(captured(c, joined("<b>ACTRN", F.col("rec_no"), "</b>"), per=20), now()).select("url", "title")
)


def _preprints(c: DataFrame) -> DataFrame:
    r = F.to_json(F.struct(joined("10.2/", F.col("rec_no")).alias("doi"), F.col("summary").alias("title"), F.col("violation_details").alias("abstract"), day().alias("date")))
    pages = captured(c, r, '{"collection": [', "]}", ",", "body").withColumn("server", F.when(F.col("page") % 2 == 0, "bio").otherwise("med"))
    return L.preprints_json(pages, ["recall", "batch"], now()).select("url", "title")


on_citations("src16_preprints", f"{O.CIT}, k as (select *, row_number() over (partition by (rec_no // {PER_PAGE}) % 2 order by rec_no) as k from raw) select 'https://doi.org/10.2/' || rec_no as url, summary as title from k where k <= 500 and regexp_matches(lower(summary || ' ' || violation_details), 'recall|batch')")(_preprints)
on_citations("src19_sitemap", f"{O.CIT} select 'https://s/buy/' || rec_no || '/zinc' as url, rec_no as product_id from raw where rec_no % 3 = 0 order by rec_no desc limit 20")(
    lambda c: P.sitemap_urls(captured(c, joined("<url><loc> https://s/buy/", F.col("rec_no"), F.when(F.col("rec_no") % 3 == 0, "/zinc").otherwise("/other"), "</loc></url>"), name="body"), ["zinc"])
)


def _products(c: DataFrame) -> DataFrame:
    r = F.to_json(F.struct(F.lit("Product").alias("@type"), joined("S", F.col("rec_no")).alias("sku"), F.col("summary").alias("name"), F.struct(F.col("authority").alias("name")).alias("brand"), F.struct((F.col("rec_no") % 50).cast("string").alias("price")).alias("offers")))
    pages = c.select(F.col("rec_no").alias("page_id"), "url", joined('<html><script type="application/ld+json">', r, "</script></html>").alias("html"))
    return L.product_pages(pages, now(), 30).select("url", "title", "body_text")


on_citations("src20_product_pages", f"{O.CIT} select url, summary as title, 'Brand: ' || authority || chr(10) || 'Price: AU$' || (rec_no % 50) as body_text from raw order by rec_no limit 30")(_products)


def _enforcement(c: DataFrame) -> DataFrame:
    r = F.to_json(F.struct(F.col("summary").alias("product_description"), F.col("company").alias("recalling_firm"), F.col("violation_details").alias("reason_for_recall"), joined("Z-", F.col("rec_no")).alias("recall_number"), day("yyyyMMdd").alias("recall_initiation_date"), F.when(F.col("rec_no") % 3 == 0, "Class I").when(F.col("rec_no") % 3 == 1, "Class II").otherwise("").alias("classification")))
    bodies = captured(c, r, '{"results": [', "]}", ",", "body").withColumn("url", F.lit("https://q"))
    return P.enforcement_json(bodies, "drug", "auto", cutoff("1995-06-01")).select("url", F.date_format("date", "yyyy-MM-dd").alias("date"), "severity", "facility_type", "violation_details")


_ENF = "concat_ws(' ', summary, violation_details, company)"
on_citations(
    "src23_enforcement_json",
    f"{O.CIT} select 'https://www.accessdata.fda.gov/scripts/ires/?action=RecallAction&RecallNumber=Z-' || rec_no as url, strftime(date, '%Y-%m-%d') as date, case rec_no % 3 when 0 then 'high' when 1 then 'medium' else {severity(_ENF, chr(39) + 'drug_enforcement' + chr(39))} end as severity, {facility(_ENF)} as facility_type, substr({_ENF}, 1, 500) as violation_details from raw where date is null or date >= date '1995-06-01'",
)(_enforcement)
QUERIES["src32_watchlist"] = lambda spark, d: _watchlist(tables(spark, d, "part")["part"].withColumn("rec_no", F.col("p_partkey")))
SQL["src32_watchlist"] = f"""with w as (select p_partkey, p_name, row_number() over (partition by p_partkey // {PER_PAGE} order by p_partkey) - 1 as ord from part)
 select ord, case when contains(p_name, 'blue') then p_name else p_name || ' blue' end as query from w where p_partkey % 7 > 0"""


def _watchlist(parts: DataFrame) -> DataFrame:
    """Configurations of consecutive parts, every seventh a comment."""
    path = S.shared_path(parts.sparkSession, "watchlist")
    name = joined('"', F.when(F.col("rec_no") % 7 == 0, "_").otherwise(""), F.col("p_name"), '"')
    docs = captured(parts, name, '{"query_suffix": "blue", "ingredients": [', "]}", ",", "value").select("value")
    docs.write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return P.watchlist_queries(parts.sparkSession, path)


def _entries(c: DataFrame) -> DataFrame:
    kind = F.when(F.col("rec_no") % 4 == 0, "Device").otherwise("Listed Medicine")
    pairs = [("Product name", F.col("summary")), ("Sponsor:", F.col("company")), ("Registration Type", kind), ("ARTG Date", day("d MMMM yyyy"))]
    a = joined(*[x for k, v in pairs for x in (f'<div class="field__label">{k}</div><div class="field__item">', v, "</div>")])
    b = joined("<table>", *[x for k, v in pairs for x in (f"<tr><th>{k}</th><td>", v, "</td></tr>")], "</table>")
    html = F.when(F.col("rec_no") % 2 == 0, a).otherwise(b)
    pages = c.select(F.col("rec_no").cast("string").alias("entry"), "url", joined("<html>", html, "</html>").alias("html"))
    return N.register_entries(pages, cutoff("1995-06-01"), now()).select("source_id", "title", "body_text")


_SP = "trim(regexp_replace(company, '\\s+', ' ', 'g'))"
on_citations(
    "src06_register_entries",
    f"""{O.CIT} select {_sid('artg', 'url')} as source_id, summary || ' (' || rec_no || ')' as title, 'ARTG ID: ' || rec_no || chr(10) || 'Date listed: ' || coalesce(strftime(date, '%Y-%m-%d'), 'unknown date') || chr(10) || 'Sponsor: ' || {_SP} || chr(10) || 'Registration type: Listed Medicine' || chr(10) || 'Therapeutic good type: ' as body_text
 from raw where rec_no % 4 <> 0 and (date is null or date >= date '1995-06-01')""",
)(_entries)


def _journal(c: DataFrame) -> DataFrame:
    item = F.to_json(F.struct(F.struct(F.col("summary").alias("title"), joined("/en/j/", F.col("rec_no") % 700).alias("url"), F.col("violation_details").alias("abstract")).alias("_source")))
    answers = captured(c.where("authority = 'FDA'"), item, '{"hits": {"hits": [', "]}}", ",", "body").select(F.col("page").alias("ord"), F.concat(F.lit("t"), "page").alias("term"), "body")
    # every fifth term has no answer and is searched
    answers = answers.withColumn("body", F.when(F.col("ord") % 5 == 0, '{"hits": {"hits": []}}').otherwise(F.col("body")))
    block = joined('<a href="/en/publications/', F.col("rec_no"), '">x</a><h2 class="title">', F.col("summary"), "</h2>")
    searches = captured(c.where("authority = 'TGA'"), block).select(F.col("page").alias("ord"), F.concat(F.lit("t"), "page").alias("term"), "html")
    feed = captured(c.where("authority = 'EFSA'"), joined("<item><link>https://f/", F.col("rec_no"), "</link><title>", F.when(F.col("rec_no") % 3 == 0, "Vitamin ").otherwise("Other "), F.col("rec_no"), "</title></item>"), per=1_000_000)
    return N.journal_cascade(answers, searches, feed, now()).select("url", "title")


on_citations(
    "src15_journal_cascade",
    f"""{O.CIT}, a as (select rec_no // {PER_PAGE} as ord, row_number() over (partition by rec_no // {PER_PAGE} order by rec_no) as pos, 'https://www.efsa.europa.eu/en/j/' || (rec_no % 700) as url, summary as title from raw where authority = 'FDA' and (rec_no // {PER_PAGE}) % 5 <> 0),
 h as (select rec_no // {PER_PAGE} as ord, row_number() over (partition by rec_no // {PER_PAGE} order by rec_no) as pos, 'https://www.efsa.europa.eu/en/publications/' || rec_no as url, case when length(summary) >= 10 then summary else 'EFSA Publication: t' || (rec_no // {PER_PAGE}) end as title from raw where authority = 'TGA'),
 h20 as (select * from h where pos <= 20 and ord not in (select ord from a)),
 f as (select 'https://f/' || rec_no as url, 'Vitamin ' || rec_no as title from raw where authority = 'EFSA' and rec_no % 3 = 0)
 select url, title from a qualify row_number() over (partition by url order by ord, pos) = 1 union all select url, title from h20 union all select url, title from f""",
)(_journal)
on_signals(
    "snk07_unsent",
    f"{O.SIG} select source_id from s where sentiment <> 'negative' and scraped_at >= timestamp '2024-01-30 00:00:00'",
)(lambda s: S.unsent(S.mark_sent(s.withColumn("digest_sent", F.lit(None).cast("boolean")), s.where("sentiment = 'negative'")), "2024-01-31 00:00:00").select("source_id"))
