"""Pages of the ninety-day report, consultations, committee calendars and review records.

Every parser is a plan of fallbacks over :func:`elements.climb` or a table grid.  Pages come as
(page, html) and JSON bodies as (page, body); a listing's order is (page, position in the page).
The report's parsers return :data:`REPORT`; others return raw notices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import any_of, parse_date, short_hash
from ..operators.display import ingredient
from ..operators.facets import keep_first
from ..operators.report90 import report_category, report_severity
from .agencies import absolute, recent, until_too_old
from .agencies import table_rows as plain_rows
from .elements import CARDS, cell_named, climb, elements, heading_of, is_card, once, stated_date, table_rows
from .parsers import as_raw, text_of

REPORT = ["id", "title", "url", "ingredient", "citation_type", "authority", "severity", "date", "company", "summary", "gmp_category", "raw_text"]
Rules = Sequence[tuple[str, Sequence[str]]]

# Words that make an item relevant, and default labels
LETTER_SUBJECT = "Dietary Supplement|CGMP/Dietary|Supplement/Adulterated|Supplement/Misbranded|Infant Formula|FSVP|Food Safety|Undeclared"
LETTER_TERMS = (
    "dietary supplement|nutraceutical|GMP|cgmp|good manufacturing|vitamin|mineral|herbal|botanical|probiotic|protein powder|sports nutrition"
)
FOOD_TERMS = (
    "vitamin|mineral|supplement|botanical|herbal|nutrient|food safety|contaminant|pesticide|heavy metal|mycotoxin|probiotic|health claim"
)
MEDICINE_TERMS = (
    "vitamin|mineral|supplement|botanical|herbal|nutrient|food|GMP|gmp|non-compliance|inspection|manufacturing|recall|withdrawal|"
    "contamination|heavy metal|mycotoxin|probiotic|omega"
)
COMMITTEE_TERMS = [
    "supplement", "botanical", "herbal", "vitamin", "mineral", "nutraceutical", "dietary", "natural product", "phytotherapy",
    "traditional medicine", "omega", "probiotic", "melatonin", "kava", "echinacea", "valerian", "coenzyme", "coq10", "adapto",
    "ashwagandha", "turmeric", "curcumin", "green tea", "ginkgo", "ginseng", "elderberry", "cannabidiol", "cbd",
]
NON_COMPLIANT = "CGMP Non-compliance"
REVIEW_JOURNAL = "Cochrane Database Syst Rev"
MEETING = r"(\d{1,2}[–\-]\d{1,2}\s+\w+\s+\d{4}|\d{1,2}\s+\w+\s+\d{4})"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _raw(*names: str) -> Column:
    """Texts with a blank between them, empty ones too."""
    return F.concat_ws(" ", *map(_text, names))


def as_report(rows: DataFrame, tag: str, authority: str, rules: Rules, key: Column | None = None) -> DataFrame:
    """Report rows from (title, url, citation_type, date, raw) and optional company, summary,
    gmp_category and severity."""
    have = rows.columns
    own = lambda c, otherwise: F.col(c) if c in have else otherwise
    return rows.select(
        short_hash(F.lit(tag), F.col("url") if key is None else key, bits=128, length=10).alias("id"),
        "title",
        "url",
        ingredient(F.col("raw"), rules).alias("ingredient"),
        "citation_type",
        F.lit(authority).alias("authority"),
        own("severity", report_severity(F.col("raw"), F.col("citation_type"))).alias("severity"),
        "date",
        own("company", F.lit("")).alias("company"),
        own("summary", F.lit("")).alias("summary"),
        own("gmp_category", F.lit("")).alias("gmp_category"),
        F.col("raw").alias("raw_text"),
    )


def _articles(pages: DataFrame, base: str, cutoff: Column, *cards: str) -> DataFrame:
    """Linked articles of pages, else their cards; recent or undated: adds title, url, summary, raw."""
    wanted = F.array(*map(F.lit, cards or sorted(CARDS)))
    rows = climb(pages, lambda e: e["tag"] == "article", lambda e: F.arrays_overlap(F.split(e["class"], " "), wanted))
    rows = once(rows, date=stated_date()).where(F.coalesce("head_href", "href").isNotNull())
    rows = recent(rows, cutoff).withColumn("summary", _text("teaser"))
    title = F.when(F.col("head_href").isNotNull(), F.col("head")).otherwise(F.col("link"))
    return rows.withColumn("title", title).withColumn("url", absolute(F.coalesce("head_href", "href"), base)).withColumn("raw", _raw("title", "summary"))


def safety_alerts(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.tga.gov.au") -> DataFrame:
    rows = _articles(pages, base, cutoff, "views-row")
    return as_report(rows.withColumn("citation_type", F.when(F.lower("title").contains("ban"), "ban").otherwise("safety_alert")), "TGA", "TGA", rules)


def recalls(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.tga.gov.au") -> DataFrame:
    """A recall by its title, else an advisory by title or teaser, else a recall."""
    low = F.lower("title")
    kind = F.when(low.contains("recall"), "recall").when(low.contains("advisory") | F.lower("summary").contains("advisory"), "safety_alert")
    return as_report(_articles(pages, base, cutoff, "views-row").withColumn("citation_type", kind.otherwise("recall")), "TGA_recall", "TGA", rules)


ACTIONS = "results array<struct<" + ", ".join(
    f"{c}: string"
    for c in ("product_description", "recalling_firm", "reason_for_recall", "recall_number", "recall_initiation_date", "report_date", "classification")
) + ">>"


def enforcement(bodies: DataFrame, cutoff: Column, rules: Rules) -> DataFrame:
    """Enforcement records of JSON bodies; the class gives the severity, else the text does."""
    r = bodies.select(F.explode(F.from_json("body", ACTIONS)["results"]).alias("r")).select("r.*")
    title = F.substring(F.coalesce("product_description", F.lit("FDA Enforcement")), 1, 200)
    url = F.concat(F.lit("https://www.accessdata.fda.gov/scripts/ires/?action=RecallAction&RecallNumber="), _text("recall_number"))
    r = r.withColumn("date", parse_date(F.coalesce("recall_initiation_date", "report_date"))).withColumn("title", title)
    r = recent(r, cutoff).withColumn("url", url).withColumn("summary", _text("reason_for_recall")).withColumn("raw", _raw("title", "summary"))
    code, kind = F.lower(_text("classification")), F.lit("recall")
    severity = F.when(code.contains("class ii"), "medium").when(code.contains("class i"), "high").otherwise(report_severity(F.col("raw"), kind))
    r = r.withColumn("severity", severity).withColumn("citation_type", kind).withColumn("company", _text("recalling_firm"))
    return as_report(r, "FDA_enf", "FDA", rules, F.coalesce(F.nullif("recall_number", F.lit("")), "url"))


LETTER_CELLS = "data array<array<string>>"


def _letter(rows: DataFrame, tag: str, by_subject: bool, rules: Rules) -> DataFrame:
    named = F.col("subject" if by_subject else "raw")
    rows = rows.withColumn("gmp_category", report_category(F.col("raw")))
    gmp = F.upper(named).contains("GMP") | (F.col("gmp_category") != "")
    rows = rows.withColumn("citation_type", F.when(gmp, "GMP_violation").otherwise("warning_letter")).withColumn("summary", F.col("subject"))
    return as_report(rows, tag, "FDA", rules)


def letters(bodies: DataFrame, pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.fda.gov", home: str = "https://www.fda.gov/letters") -> DataFrame:
    """Letters of JSON pages, newest first up to the first too old one, first of each address; where they
    give none, recent rows of the first table of each HTML page."""
    cells = bodies.select("page", F.posexplode(F.from_json("body", LETTER_CELLS)["data"]).alias("pos", "cell")).where(F.size("cell") >= 3)
    get = lambda i: F.coalesce(F.get("cell", i), F.lit(""))
    stamp = F.coalesce(F.nullif(F.regexp_extract(get(0), r"""(?is)<time\b[^>]*?\bdatetime=["']([^"']*)["']""", 1), F.lit("")), text_of(get(0)))
    link = lambda c: F.nullif(F.regexp_extract(c, r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']""", 1), F.lit(""))
    to = lambda c: F.coalesce(absolute(link(c), base), F.lit(home))
    subject = text_of(F.coalesce(F.get("cell", 4), F.element_at("cell", -1)))
    a = until_too_old(once(cells, said=stamp).withColumn("date", parse_date("said")), cutoff)
    a = a.select("page", "pos", "date", text_of(get(2)).alias("company"), to(get(2)).alias("url"), text_of(get(3)).alias("office"), subject.alias("subject"))
    a = keep_first(a, F.col("url"), F.col("page"), F.col("pos")).withColumn("raw", _raw("subject", "company", "office"))
    a = a.where(F.col("raw").rlike(f"(?i){LETTER_SUBJECT}|{LETTER_TERMS}"))
    title = F.when(F.col("subject") != "", F.substring(F.concat("company", F.lit(" — "), "subject"), 1, 200)).otherwise(F.col("company"))
    first = F.regexp_extract("html", r"(?is)<table\b.*?</table>", 0)
    b = plain_rows(pages.withColumn("html", first)).where(F.size("cell") >= 2)
    b = recent(once(b, said=text_of(get(0))).withColumn("date", parse_date("said")), cutoff)
    b = b.select("date", to(get(1)).alias("url"), text_of(get(1)).alias("subject"), text_of(get(3)).alias("company")).withColumn("raw", _raw("subject", "company"))
    b = b.where(F.col("raw").rlike(f"(?i){LETTER_TERMS}")).withColumn("title", F.col("subject"))
    # one row at most on the other side
    some = a.limit(1).select(F.lit(True).alias("some"))
    b = b.join(F.broadcast(some), F.col("some"), "left_anti")
    return _letter(a.withColumn("title", title), "FDA_WL", True, rules).unionByName(_letter(b, "FDA_WL_html", False, rules))


def inspections(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.fda.gov", home: str = "https://www.fda.gov/observations") -> DataFrame:
    """Observations of (listing, page, html): rows of three cells in table bodies, merged cells at every row
    that they cover.  Date and firm come from the columns so named, else from the first two."""
    r = table_rows(pages).where((F.col("part") == "tbody") & (F.size("cells") >= 3))
    r = once(r, said=cell_named("(?i)date", 0), firm=_text(cell_named("(?i)firm|company", 1)))
    r = recent(r.withColumn("date", parse_date("said")), cutoff)
    told = F.transform(F.filter("cells", lambda c: c["origin"] & (c["text"] != "")), lambda c: c["text"])
    r = once(r, raw=F.array_join(told, " ")).where("raw <> ''").withColumn("company", F.col("firm"))
    linked = F.get(F.filter("cells", lambda c: c["href"].isNotNull()), 0)["href"]
    r = r.withColumn("url", F.coalesce(absolute(linked, base), F.lit(home))).withColumn("title", F.substring("raw", 1, 150)).withColumn("summary", F.substring("raw", 1, 300))
    kind = F.coalesce(F.nullif(report_category(F.col("raw")), F.lit("")), F.lit(NON_COMPLIANT))
    r = r.withColumn("citation_type", F.lit("inspection_finding")).withColumn("gmp_category", kind)
    return as_report(r, "FDA_483", "FDA", rules, F.concat("url", F.substring("raw", 1, 30)))


def food_news(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.efsa.europa.eu") -> DataFrame:
    rows = _articles(pages, base, cutoff).withColumn("title", F.coalesce(F.nullif("link", F.lit("")), F.nullif("head", F.lit("")), F.substring("text", 1, 120)))
    rows = rows.withColumn("url", absolute(F.col("href"), base)).withColumn("raw", _raw("title", "summary")).where(F.col("raw").rlike(f"(?i){FOOD_TERMS}"))
    return as_report(rows.withColumn("citation_type", F.lit("safety_alert")), "EFSA", "EFSA", rules)


def medicine_news(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.ema.europa.eu") -> DataFrame:
    rows = _articles(pages, base, cutoff).withColumn("title", F.coalesce(F.nullif("head", F.lit("")), "link")).where(F.length("title") >= 10)
    rows = rows.withColumn("raw", _raw("title", "summary")).where(F.col("raw").rlike(f"(?i){MEDICINE_TERMS}"))
    named = F.when(F.upper("raw").contains("GMP"), NON_COMPLIANT).otherwise("")
    rows = rows.withColumn("gmp_category", F.coalesce(F.nullif(report_category(F.col("raw")), F.lit("")), named))
    kind = F.when(F.col("gmp_category") != "", "GMP_violation").otherwise("inspection_finding")
    return as_report(rows.withColumn("citation_type", kind), "EMA_news", "EMA", rules)


def herbal_opinions(pages: DataFrame, cutoff: Column, rules: Rules, base: str = "https://www.ema.europa.eu", most: int = 30) -> DataFrame:
    """Opinions among the first ``most`` items of a page that name a known ingredient."""
    d = elements(pages)
    items = F.slice(F.filter("elements", lambda e: (e["tag"] == "article") | is_card(e)), 1, most)
    rows = d.select(F.explode(items).alias("e")).select("e.*").where("href is not null")
    rows = recent(once(rows, date=stated_date()), cutoff).select(F.col("link").alias("title"), absolute(F.col("href"), base).alias("url"), "date", F.col("link").alias("summary"), F.col("link").alias("raw"))
    return as_report(rows.withColumn("citation_type", F.lit("safety_alert")), "EMA_herbal", "EMA", rules).where("ingredient <> 'Unknown'")


def consultations(pages: DataFrame, keywords: Sequence[str], now: Column, base: str = "https://www.tga.gov.au", authority: str = "tga_consultations") -> DataFrame:
    """Relevant consultations: table rows with a linked title, else cards, else links that look like one;
    the first of each address."""
    words = lambda c: any_of(F.lower(c), keywords)
    rows = climb(
        pages,
        lambda e: (e["tag"] == "tr") & (F.size(e["cells"]) >= 2) & F.get(e["cells"], 0)["href"].isNotNull(),
        lambda e: ((e["tag"] == "article") | e["class"].rlike(r"\b(views-row|in-item-list)\b")) & e["href"].isNotNull(),
        lambda e: (e["tag"] == "a") & (F.length(e["link"]) >= 15) & (F.lower(e["href"]).contains("consultation") | words(e["link"])),
    )
    cell = lambda i: _text(F.get("cells", i)["text"])
    low = F.lower("text")
    rows = rows.withColumn("url", absolute(F.when(F.col("rung") == 0, F.get("cells", 0)["href"]).otherwise(F.col("href")), base))
    rows = keep_first(rows, F.col("url"), F.col("page"), F.col("pos")).withColumn("title", F.substring("link", 1, 300))
    guessed = F.when(low.contains("open"), "open").when(low.contains("closed"), "closed").otherwise("unknown")
    body = (
        F.when(F.col("rung") == 0, F.format_string("Consultation: %s\nStatus: %s\nDates: %s\nURL: %s", "title", cell(1), cell(2), "url"))
        .when(F.col("rung") == 1, F.format_string("Consultation: %s\nStatus: %s\nDate: %s\nContext: %s\nURL: %s", "title", guessed, F.regexp_extract("text", r"\d{1,2}\s+\w+\s+\d{4}", 0), F.substring("text", 1, 500), "url"))
        .otherwise(F.format_string("Title: %s\nURL: %s", "link", "url"))
    )
    rows = rows.withColumn("body_text", body).where(words(F.concat_ws(" ", "title", "body_text")))
    return as_raw(rows.select("url", "title", "body_text", now.alias("scraped_at")), authority)


def committee_calendar(pages: DataFrame, now: Column, home: str, base: str = "https://www.fda.gov", keywords: Sequence[str] = tuple(COMMITTEE_TERMS)) -> DataFrame:
    """Relevant meetings: table rows of two cells, else relevant links; the first of each address."""
    words = lambda c: any_of(F.lower(c), keywords)
    rows = climb(pages, lambda e: (e["tag"] == "tr") & (F.size(e["cells"]) >= 2) & words(e["text"]), lambda e: (e["tag"] == "a") & words(e["text"]))
    rows = keep_first(rows.withColumn("url", F.coalesce(absolute(F.col("href"), base), F.lit(home))), F.col("url"), F.col("page"), F.col("pos"))
    cell = lambda i: _text(F.get("cells", i)["text"])
    agenda = F.array_join(F.transform(F.slice("cells", 3, 1000), lambda c: c["text"]), " | ")
    tabled = F.col("rung") == 0
    title = F.when(tabled, F.concat(F.lit("FDA Advisory Committee: "), F.substring(cell(1), 1, 100))).otherwise(F.concat(F.lit("FDA Advisory: "), F.substring("text", 1, 150)))
    source = F.lit("Source: FDA Advisory Committee Calendar\n")
    body = F.when(tabled, F.concat(source, F.format_string("Committee: %s\nMeeting Date: %s\nAgenda Items: %s\nURL: %s", cell(1), cell(0), F.substring(agenda, 1, 500), "url")))
    body = body.otherwise(F.concat(source, F.format_string("Agenda Item: %s\nURL: %s", "text", "url")))
    key = F.concat_ws("::", F.lit("fda"), "url", F.when(tabled, cell(0)))
    rows = rows.select("url", title.alias("title"), body.alias("body_text"), now.alias("scraped_at"), key.alias("key"))
    return as_raw(rows, "advisory_committee", F.col("key"))


def committee_sections(pages: DataFrame, now: Column, home: str, base: str = "https://www.ema.europa.eu", keywords: Sequence[str] = tuple(COMMITTEE_TERMS)) -> DataFrame:
    """Relevant rows and list items with the heading above them; the first of each address."""
    rows = climb(pages, lambda e: e["tag"].isin("tr", "li") & (e["text"] != "") & any_of(F.lower(F.concat_ws(" ", e["text"], heading_of(e))), keywords))
    rows = keep_first(rows.withColumn("url", F.coalesce(absolute(F.col("href"), base), F.lit(home))), F.col("url"), F.col("page"), F.col("pos"))
    day = F.regexp_extract("text", MEETING, 1)
    body = F.format_string("Source: EMA Committee Meeting Calendar\nCommittee: %s\nMeeting: %s\nDate: %s\nURL: %s", "heading", F.substring("text", 1, 300), day, "url")
    rows = rows.select("url", F.concat(F.lit("EMA "), "heading", F.lit(": "), F.substring("text", 1, 100)).alias("title"), body.alias("body_text"), now.alias("scraped_at"), F.concat_ws("::", F.lit("ema"), "url", day).alias("key"))
    return as_raw(rows, "advisory_committee", F.col("key"))


REVIEW = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>,"
    " Journal: struct<JournalIssue: struct<PubDate: struct<Year: string, Month: string>>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>,"
    " MedlineJournalInfo: struct<MedlineTA: string>>, PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>"
)


def reviews_xml(spark: SparkSession, path: str, as_of: Column, now: Column, days: int = 365, journal: str = REVIEW_JOURNAL) -> DataFrame:
    """Review notices of one journal in literature XML, published in the ``days`` before ``as_of`` by
    the last day of their month; records without a year are left out, one row a record id."""
    d = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(REVIEW).load(path)
    d = d.select("MedlineCitation.*", F.col("PubmedData.ArticleIdList.ArticleId").alias("ids")).where(F.col("MedlineJournalInfo.MedlineTA") == journal)
    issue = F.col("Article.Journal.JournalIssue.PubDate")
    year, month = _text(issue["Year"]), _text(issue["Month"])
    named = F.concat_ws("-", year, F.when(month == "", "01").otherwise(F.initcap(month)), F.lit("01"))
    at = F.last_day(F.to_date(F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in ("yyyy-M-dd", "yyyy-MMM-dd", "yyyy-MMMM-dd")])))
    d = d.where(at >= F.date_sub(as_of, days)).dropDuplicates(["PMID"])
    authors = F.filter(F.slice(F.coalesce("Article.AuthorList.Author", F.array()), 1, 5), lambda x: _text(x["LastName"]) != "")
    names = F.array_join(F.transform(authors, lambda x: F.trim(F.concat_ws(" ", x["LastName"], x["ForeName"]))), "; ")
    doi = F.trim(F.get(F.filter("ids", lambda x: x["_IdType"] == "doi"), 0)["_VALUE"])
    abstract = F.trim(F.array_join(F.coalesce("Article.Abstract.AbstractText", F.array()), " "))
    body = F.format_string(
        "[COCHRANE SYSTEMATIC REVIEW]\nPMID: %s\nDOI: %s\nAuthors: %s\nPublished: %s-%s\n\nAbstract:\n%s",
        F.col("PMID"), F.coalesce(F.nullif(doi, F.lit("")), F.lit("N/A")), names, year, month, F.coalesce(F.nullif(abstract, F.lit("")), F.lit("See full review at Cochrane Library.")),
    )
    title = F.coalesce("Article.ArticleTitle", F.concat(F.lit("Cochrane Review PMID "), "PMID"))
    rows = d.select(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "PMID", F.lit("/")).alias("url"), title.alias("title"), body.alias("body_text"), now.alias("scraped_at"))
    return as_raw(rows, "cochrane")
