"""Captured agency pages to citation rows, in DataFrame functions alone.

Bodies come as (page, html) or (page, body); a listing's order is (page, position in the page).
Every parser returns the citation columns of :data:`COLUMNS`, first of each address; facility,
category and severity follow the shared text rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import icase, parse_date, short_hash
from ..operators.citations import first_category, infer_facility, infer_severity
from ..operators.facets import keep_first
from .parsers import text_of

COLUMNS = ["id", "authority", "source_type", "company", "date", "category", "severity", "summary", "url", "product_type", "country", "facility_type", "violation_details"]
HREF = r"""(?is)<a\b[^>]*?\bhref=["']([^"']*)["']"""
ANCHOR = r"(?is)<a\b[^>]*?\bhref=[^>]*>(.*?)</a>"
DEFAULT_CATEGORY = "GMP violations"

# They decide which notices are kept and how they are typed.
IMPORT_ALERT_PREFIXES = ["56-", "57-", "63-", "66-", "88-", "89-", "99-"]
IMPORT_ALERT_FACILITY = [("57-", "Biologics / Vaccine"), ("89-", "Supplement / Nutraceutical"), ("63-", "Medical Device")]
COMPANY = r"(?:by|issued to|sponsor:?)\s+([A-Z][A-Za-z\s&,\.]{3,40})"
MHRA_TERMS = (
    "vitamin|mineral|supplement|herbal|botanical|probiotic|omega|fish oil|collagen|protein|weight loss|food supplement|nutraceutical|"
    "gmp|good manufacturing|non.compliance|defective|falsified|counterfeit|sterile|aseptic|parenteral|biologic|vaccine|api|drug substance|"
    "nitrosamine|impurity|recall|withdrawal|alert|safety|device"
)
EFSA_TERMS = (
    "vitamin|mineral|supplement|botanical|herbal|probiotic|health claim|omega.?3|fish oil|collagen|amino acid|astaxanthin|melatonin|coenzyme|"
    "glucosamine|l.carnitine|selenium|zinc|magnesium|iron|calcium|copper|chromium|iodine|novel food|cannabis|hemp|cbd|"
    "contaminant|heavy metal|mycotoxin|aflatoxin|cadmium|lead|arsenic|pesticide|food additive|food enzyme|feed additive|"
    "tolerable upper|maximum level|safe intake|upper intake|dietary intake|nutrient|safety opinion|nda|risk assessment"
)
EFSA_DATE = r"(?i)\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
EFSA_TYPES = r"^(Scientific Opinion|Statement|Technical Report|Event report|Scientific Report|News|Guidance)"
BFR_TERMS = (
    "vitamin|mineral|supplement|herbal|botanical|probiotic|omega.?3|fish oil|collagen|protein|creatine|weight loss|food supplement|"
    "nutraceutical|contaminant|heavy metal|mycotoxin|food safety|risk assessment|maximum|tolerable|upper level|safety|warning|recall|"
    "pesticide|additive|flavouring"
)
BFR_LABEL = r"Category\s+([A-Za-z /]+?)(?:\d|$|\n)"


def _cut(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def blocks(pages: DataFrame, tag: str, mark: str = "") -> DataFrame:
    """(…, pos, block): inner HTML of a page's elements whose opening tag holds ``mark``."""
    inner = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*{mark}[^>]*>(.*?)</{tag}>"), 1)
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(inner).alias("pos", "block"))


def table_rows(pages: DataFrame) -> DataFrame:
    """(…, pos, block, cell): table rows with the inner HTML of their cells."""
    cells = F.regexp_extract_all("block", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    return blocks(pages, "tr").withColumn("cell", cells).where(F.size("cell") > 0)


def listed(pages: DataFrame, tag: str, mark: str = "") -> DataFrame:
    """Blocks with a link: adds href, title, stamp (a time element's), teaser and text."""
    b = blocks(pages, tag, mark).withColumn("href", _cut(F.col("block"), HREF)).where("href is not null")
    headed = _cut(F.col("block"), r"(?is)<h[23]\b[^>]*>(.*?)</h[23]>")
    return (
        b.withColumn("href", F.coalesce(_cut(headed, HREF), F.col("href")))
        .withColumn("title", text_of(F.coalesce(_cut(headed, ANCHOR), _cut(F.col("block"), ANCHOR), F.lit(""))))
        .withColumn("stamp", _cut(F.col("block"), r"""(?is)<time\b[^>]*?\bdatetime=["']([^"']*)["']"""))
        .withColumn("timed", F.col("block").rlike(r"(?i)<time\b"))
        .withColumn("teaser", text_of(F.coalesce(_cut(F.col("block"), r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(""))))
        .withColumn("text", text_of(F.col("block")))
    )


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def until_too_old(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Rows of a listing before its first row older than ``cutoff``: one minimum, joined back."""
    rows = rows.withColumn("at", F.struct("page", "pos"))
    stop = rows.agg(F.min(F.when(F.col("date") < cutoff, F.col("at"))).alias("stop"))
    return rows.join(F.broadcast(stop)).where("stop is null or at < stop").drop("stop", "at")


def recent(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.where(F.col("date").isNull() | (F.col("date") >= cutoff))


def as_citations(rows: DataFrame, tag: str, authority: str, country: str, key: str = "url") -> DataFrame:
    """Citation rows from (page, pos, url, source_type, date, summary, raw, product_type) and
    optional company, facility_type and severity_type; the first row of each ``key``."""
    have = rows.columns
    facility = F.col("facility_type") if "facility_type" in have else infer_facility(F.col("raw"))
    judged = F.col("severity_type") if "severity_type" in have else F.col("source_type")
    out = keep_first(rows, F.col(key), F.col("page"), F.col("pos"))
    return out.select(
        short_hash(F.lit(tag), F.col(key), bits=128, length=12).alias("id"), F.lit(authority).alias("authority"), "source_type",
        (F.col("company") if "company" in have else F.lit("")).alias("company"), "date", first_category(F.col("raw"), DEFAULT_CATEGORY).alias("category"),
        infer_severity(F.col("raw"), judged).alias("severity"), F.substring("summary", 1, 300).alias("summary"), "url", "product_type",
        F.lit(country).alias("country"), facility.alias("facility_type"), F.substring("raw", 1, 500).alias("violation_details"),
    )


LETTER_PAGE = "data array<array<string>>"


def warning_letters(bodies: DataFrame, html_pages: DataFrame, cutoff: Column, base: str = "https://www.fda.gov") -> DataFrame:
    """Warning letters from JSON pages (page, body) of eight cells, or from the HTML table
    (page, html) where no JSON page has a letter; newest first, up to the first too old one."""
    cells = bodies.select("page", F.from_json("body", LETTER_PAGE).alias("j")).select("page", F.posexplode("j.data").alias("pos", "cell"))
    paged = _letters(cells, base)
    tabled = _letters(table_rows(html_pages).where(F.size("cell") >= 5).select("page", "pos", "cell"), base)
    # one row at most on the other side
    some = paged.limit(1).select(F.lit(True).alias("some"))
    rows = until_too_old(paged, cutoff).unionByName(until_too_old(tabled, cutoff).join(F.broadcast(some), F.col("some"), "left_anti"))
    return as_citations(rows, "FDA_WL", "FDA", "United States")


def _letters(cells: DataFrame, base: str) -> DataFrame:
    cell = lambda i: F.coalesce(F.get("cell", i), F.lit(""))
    href = _cut(cell(2), HREF)
    rows = cells.where(href.isNotNull()).select("page", "pos", absolute(href, base).alias("url"), text_of(cell(2)).alias("company"), text_of(cell(4)).alias("summary"), text_of(cell(7)).alias("excerpt"), parse_date(text_of(cell(0)), month_first=True).alias("date"))
    filled = [F.nullif(c, F.lit("")) for c in ("summary", "company", "excerpt")]
    return rows.select("*", F.concat_ws(" ", *filled).alias("raw"), F.lit("warning_letter").alias("source_type"), F.lit("FDA Warning Letter").alias("product_type")).drop("excerpt")


def import_alerts(pages: DataFrame, cutoff: Column, base: str = "https://www.accessdata.fda.gov/cms_ia") -> DataFrame:
    """Import alerts of the listed number prefixes; the prefix names the facility where the text doesn't."""
    rows = table_rows(pages).where(F.size("cell") >= 4)
    rows = rows.select("page", "pos", text_of(F.get("cell", 0)).alias("number"), text_of(F.get("cell", 1)).alias("type"), parse_date(text_of(F.get("cell", 2))).alias("date"), text_of(F.get("cell", 3)).alias("summary"), F.coalesce(_cut(F.col("block"), HREF), F.lit("")).alias("href"))
    rows = rows.where(F.col("number").rlike("^(?:" + "|".join(IMPORT_ALERT_PREFIXES) + ")"))
    rows = rows.withColumn("raw", F.concat_ws(" ", "number", "summary")).withColumn("found", infer_facility(F.col("raw")))
    facility = F
    for p, label in IMPORT_ALERT_FACILITY:
        facility = facility.when((F.col("found") == "General Pharma") & F.col("number").startswith(p), label)
    url = F.when(F.col("href") == "", F.lit(f"{base}/ialist.html")).otherwise(absolute(F.col("href"), f"{base}/"))
    rows = rows.select(
        "page", "pos", "number", url.alias("url"), "date", "summary", "raw", facility.otherwise(F.col("found")).alias("facility_type"),
        F.lit("import_alert").alias("source_type"), F.concat(F.lit("Import Alert "), "type").alias("product_type"),
    )
    return as_citations(recent(rows, cutoff), "FDA_IA", "FDA", "United States", "number")


def market_actions(pages: DataFrame, cutoff: Column, base: str = "https://www.tga.gov.au") -> DataFrame:
    """Dated articles of (page, html, default_type) after each page's first; a recall or an alert in the
    title overrides the page's type, and a firm named in the text is the company."""
    a = listed(pages, "article").where("pos > 0 and timed")
    raw, low = F.concat_ws(" ", "title", "teaser"), F.lower("title")
    kind = F.when(low.contains("recall"), "recall").when(low.contains("alert") | low.contains("advisory"), "safety_alert").otherwise(F.col("default_type"))
    rows = a.select(
        "page", "pos", absolute(F.col("href"), base).alias("url"), parse_date("stamp").alias("date"), F.coalesce(F.nullif("teaser", F.lit("")), "title").alias("summary"), raw.alias("raw"),
        kind.alias("source_type"), F.trim(F.regexp_extract(raw, COMPANY, 1)).alias("company"), F.lit("Therapeutic Good (AU)").alias("product_type"),
    )
    return as_citations(recent(rows, cutoff), "TGA", "TGA", "Australia")


def safety_updates(updates: DataFrame, publications: DataFrame, cutoff: Column, base: str = "https://www.gov.uk") -> DataFrame:
    """Relevant updates (page, html) up to the first too old one, then publications (page, html,
    default_type); an inspection finding that is guidance by address or title is typed so."""
    def items(pages: DataFrame, *more: str) -> DataFrame:
        b = listed(pages, "li", "gem-c-document-list__item")
        return b.select("page", "pos", *more, absolute(F.col("href"), base).alias("url"), parse_date("stamp").alias("date"), F.coalesce(F.nullif("teaser", F.lit("")), "title").alias("summary"), F.concat_ws(" ", "title", "teaser").alias("raw"))

    first = until_too_old(items(updates), cutoff).where(F.col("raw").rlike(icase(MHRA_TERMS)))
    first = first.select("*", F.lit("compliance_action").alias("source_type"), F.lit("Medicine / Supplement (UK)").alias("product_type"))
    more = recent(items(publications, "default_type"), cutoff).join(first.select("url").distinct(), "url", "left_anti")
    guide = (F.col("default_type") == "inspection_finding") & (F.col("url").contains("/guidance/") | F.col("raw").rlike(icase(R.GUIDANCE_TITLE))) & ~F.col("raw").rlike(icase(R.ENFORCEMENT_SIGNAL))
    more = more.select("*", F.when(guide, "guidance").otherwise(F.col("default_type")).alias("source_type"), F.col("default_type").alias("severity_type"), F.lit("Medicine / GMP (UK)").alias("product_type"))
    return as_citations(first, "MHRA_DSU", "MHRA", "United Kingdom").unionByName(as_citations(more, "MHRA_GMP", "MHRA", "United Kingdom"))


def publications(pages: DataFrame, cutoff: Column, base: str = "https://www.efsa.europa.eu") -> DataFrame:
    """Relevant publications up to the first too old one; the type leads the item's text."""
    b = listed(pages, "div", "views-row")
    kind = F.coalesce(_cut(F.col("text"), EFSA_TYPES), F.lit("Scientific Output"))
    rows = b.select(
        "page", "pos", absolute(F.col("href"), base).alias("url"), parse_date(F.regexp_replace(_cut(F.col("text"), EFSA_DATE), r"\s+", " ")).alias("date"), F.col("title").alias("summary"),
        F.concat_ws(" ", "title", F.substring("text", 1, 400)).alias("raw"), F.when(kind == "News", "compliance_action").when(kind == "Guidance", "guidance").otherwise("scientific_opinion").alias("source_type"),
        F.concat(F.lit("EFSA "), kind).alias("product_type"), F.lit("Supplement / Nutraceutical").alias("facility_type"),
    )
    return as_citations(until_too_old(rows, cutoff).where(F.col("raw").rlike(icase(EFSA_TERMS))), "EFSA", "EFSA", "EU")


def assessments(pages: DataFrame, cutoff: Column, base: str = "https://www.bfr.bund.de") -> DataFrame:
    """Relevant articles; the category label of the text gives the type."""
    b = listed(pages, "article")
    title = F.trim(F.regexp_replace("title", "^Read", ""))
    label = F.lower(F.coalesce(F.trim(_cut(F.col("text"), BFR_LABEL)), F.lit("BfR Publication")))
    has = lambda *names: label.rlike("|".join(names))
    kind = F.when(has("press", "faq", "comms"), "compliance_action").when(has("consultation", "opinion", "assessment", "review"), "scientific_opinion").when(has("guidance"), "guidance").otherwise("scientific_opinion")
    date = F.when(F.col("timed"), parse_date("stamp")).otherwise(parse_date(_cut(F.col("text"), r"\b(\d{2}/\d{2}/\d{4})\b")))
    rows = b.select(
        "page", "pos", absolute(F.col("href"), base).alias("url"), date.alias("date"), title.alias("summary"), F.concat_ws(" ", title, F.substring("text", 1, 400)).alias("raw"), kind.alias("source_type"),
        F.lit("Food Supplement / Food Safety (DE)").alias("product_type"),
    )
    return as_citations(recent(rows, cutoff).where(F.col("raw").rlike(icase(BFR_TERMS))), "BFR", "BfR", "Germany")


def page_sections(pages: DataFrame, keywords: list[str], least: int = 20, most: int = 1000) -> DataFrame:
    """(page, pos, text): headings, paragraphs and list items of ``least`` to ``most`` characters with a keyword."""
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"), 2)
    s = pages.select("page", F.posexplode(inner).alias("pos", "block")).select("page", "pos", text_of(F.col("block")).alias("text"))
    return s.where(F.length("text").between(least, most) & F.lower("text").rlike("|".join(k.lower() for k in keywords)))


def data_files(pages: DataFrame, base: str) -> DataFrame:
    """(page, pos, url): links to CSV, ZIP and spreadsheet files."""
    links = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pos", "href"))
    return links.where(F.lower("href").rlike(r"\.csv|\.zip|\.xlsx")).select("page", "pos", absolute(F.col("href"), base).alias("url"))


def relevant_composite(parts: list[DataFrame], relevance: Column) -> DataFrame:
    """Several parsers' notices together, first of each id, of high or medium relevance."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        rows = p if rows is None else rows.unionByName(p)
    rows = keep_first(rows, F.col("source_id"), F.col("part")).drop("part")
    return rows.withColumn("relevance", relevance).where(F.col("relevance").isin("high", "medium"))


STORED = "citations array<struct<" + ", ".join(f"{c}: string" for c in COLUMNS) + ">>"


def read_citation_store(spark: SparkSession, *paths: str) -> DataFrame:
    """Citations of the first readable JSON document of ``paths``; no document: no rows."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = spark.read.schema(STORED).option("multiLine", True).json(path).select(F.explode("citations").alias("c")).select("c.*")
            return rows.withColumn("date", F.to_date("date"))
    return spark.createDataFrame([], STORED).select(F.explode("citations").alias("c")).select("c.*").withColumn("date", F.to_date("date"))


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A stored table, or some of its columns; the scan reads no others."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows
