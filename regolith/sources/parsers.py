"""Captured source documents to raw notices.

Every parser takes a DataFrame of captured bodies and returns ``RawSignal`` rows
(source_id, authority, url, title, body_text, scraped_at).  Fetching is out of scope.
HTML and nested JSON are read with built-in functions; the few layouts that need a real
tag walk go through :func:`html_links`, batched through Arrow.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import any_of, blank_to_null, parse_date, short_hash
from .batches import bound_batches, rows_of_pages

RAW_COLUMNS = ["source_id", "authority", "url", "title", "body_text", "scraped_at"]


def as_raw(rows: DataFrame, authority: str, key: Column | None = None) -> DataFrame:
    """Adds the identity and cuts title and body to their lengths."""
    a = F.lit(authority)
    return rows.select(
        short_hash(a, F.col("url") if key is None else key).alias("source_id"), a.alias("authority"), "url", F.substring("title", 1, 300).alias("title"), F.substring("body_text", 1, 4000).alias("body_text"), "scraped_at"
    )


def text_of(html: Column) -> Column:
    """Text of an HTML fragment: scripts and tags out, common entities in, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def alias_of(columns: Sequence[str], *names: str) -> Column:
    """The first filled of the aliases that the table has."""
    have = [blank_to_null(n) for n in names if n in columns]
    return F.trim(F.coalesce(*have, F.lit("")))


def adverse_event_csv(rows: DataFrame, source: str, source_url: str, relevant: Sequence[str], now: Column) -> DataFrame:
    """Rows of an adverse-event file with their number ``i``; keeps relevant ones of the first 20."""
    c = rows.columns
    d = rows.where("i < 20").select(
        "i",
        alias_of(c, "PRODUCT", "Product", "product_name", "PRODUCT_NAME").alias("product"),
        alias_of(c, "REACTIONS", "Reactions", "event_type", "AE_TYPE").alias("reaction"),
        alias_of(c, "OUTCOMES", "Outcomes", "outcome", "OUTCOME").alias("outcome"),
        alias_of(c, "DATE", "Date", "report_date", "REPORT_DATE").alias("date"),
    )
    d = d.where(F.col("product") != "").where(any_of(F.lower(F.concat_ws(" ", "product", "reaction")), relevant))
    body = F.format_string("Source: %s Adverse Event Report\nProduct: %s\nAdverse Event / Reactions: %s\nOutcome: %s\nReport Date: %s", F.lit(source.upper()), "product", "reaction", "outcome", "date")
    d = d.select(F.lit(source_url).alias("url"), F.concat(F.lit("Adverse Event: "), F.substring("product", 1, 100)).alias("title"), body.alias("body_text"), now.alias("scraped_at"), "product", "i")
    return as_raw(d, "adverse_events", F.concat_ws("::", "url", "product", F.col("i").cast("string")))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file with its row number; one file is one task's work, so numbers are exact."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.withColumn("i", F.monotonically_increasing_id()).withColumn("i", F.col("i").bitwiseAND((1 << 33) - 1))


RECALL_PAGE = "data array<array<string>>"


def recall_pages(pages: DataFrame, base_url: str, keywords: Sequence[str], cutoff: Column, now: Column) -> DataFrame:
    """JSON pages (page, body) of eight HTML cells a row, newest first.

    Rows after the first too old row of the whole listing are left out even if newer: the
    position of that row is one global minimum, joined back as a bounded single row."""
    rows = pages.select("page", F.from_json("body", RECALL_PAGE).alias("j")).select("page", F.posexplode("j.data").alias("pos", "cell"))
    rows = rows.withColumn("at", F.struct("page", "pos")).withColumn("type", F.lower(text_of(F.get("cell", 3)))).where(any_of(F.col("type"), keywords))
    rows = rows.withColumn("date", parse_date(text_of(F.get("cell", 0)), month_first=True))
    stop = rows.agg(F.min(F.when(F.col("date") < cutoff, F.col("at"))).alias("stop"))
    rows = rows.join(F.broadcast(stop)).where("stop is null or at < stop")
    link = lambda i: F.nullif(F.regexp_extract(F.get("cell", i), r"""href=["']([^"']*)["']""", 1), F.lit(""))
    href = F.coalesce(link(1), link(2))
    url = F.when(href.isNull(), F.lit(base_url)).when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href))
    brand, product = text_of(F.get("cell", 1)), text_of(F.get("cell", 2))
    body = F.concat_ws("\n", F.concat(F.lit("Published: "), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown date"))), F.concat(F.lit("Product type: "), "type"), F.concat(F.lit("Reason: "), text_of(F.get("cell", 4))), F.concat(F.lit("Company: "), text_of(F.get("cell", 5))))
    return as_raw(rows.select(url.alias("url"), F.when(brand != "", F.concat(brand, F.lit(" — "), product)).otherwise(product).alias("title"), body.alias("body_text"), now.alias("scraped_at")), "fda")


LITERATURE = "resultList struct<result: array<struct<pmid: string, pmcid: string, doi: string, title: string, abstractText: string, authorString: string, journalTitle: string, firstPublicationDate: string, pubYear: string, source: string>>>"


def canonical_url(pmid: Column, doi: Column, otherwise: Column) -> Column:
    fill = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), fill(pmid), F.lit("/")), F.concat(F.lit("https://doi.org/"), fill(doi)), otherwise)


def literature_json(bodies: DataFrame, now: Column) -> DataFrame:
    """Literature search results; one canonical address a paper, first seen first."""
    r = bodies.select("page", F.posexplode(F.from_json("body", LITERATURE)["resultList"]["result"]).alias("pos", "r")).select("page", "pos", "r.*")
    title = F.regexp_replace(F.trim(F.coalesce("title", F.lit(""))), r"\.+$", "")
    other = F.coalesce(F.concat(F.lit("https://europepmc.org/article/PMC/"), blank_to_null("pmcid")), F.concat(F.lit("https://europepmc.org/search#query="), F.translate(F.substring(title, 1, 60), " ", "+")))
    na = lambda c: F.coalesce(blank_to_null(c), F.lit("N/A"))
    body = F.format_string("PMID: %s\nDOI: %s\nSource type: %s\nAuthors: %s\nJournal: %s\nDate: %s\n\nAbstract:\n%s", na("pmid"), na("doi"), F.coalesce("source", F.lit("MED")), F.coalesce("authorString", F.lit("")), F.coalesce("journalTitle", F.lit("")), F.coalesce(blank_to_null("firstPublicationDate"), blank_to_null("pubYear"), F.lit("")), F.coalesce(blank_to_null("abstractText"), F.lit("No abstract available.")))
    r = r.select("page", "pos", canonical_url(F.col("pmid"), F.col("doi"), other).alias("url"), title.alias("title"), body.alias("body_text"), now.alias("scraped_at")).where("title <> ''")
    first = r.groupBy("url").agg(F.min_by(F.struct("title", "body_text", "scraped_at"), F.struct("page", "pos")).alias("x"))
    return as_raw(first.select("url", "x.*"), "europe_pmc")


TRIALS = (
    "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>, statusModule: struct<overallStatus: string>,"
    " descriptionModule: struct<briefSummary: string>, designModule: struct<phases: array<string>>, sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>,"
    " armsInterventionsModule: struct<interventions: array<struct<name: string>>>, conditionsModule: struct<conditions: array<string>>>>>"
)


def trials_json(bodies: DataFrame, sponsors: Sequence[str], now: Column) -> DataFrame:
    """Nested trial records; adds ``competitive`` for listed sponsors."""
    p = bodies.select(F.explode(F.from_json("body", TRIALS)["studies"]).alias("s")).select("s.protocolSection.*")
    nct = F.col("identificationModule.nctId")
    sponsor = F.coalesce("sponsorCollaboratorsModule.leadSponsor.name", F.lit(""))
    rival = any_of(F.lower(sponsor), [s.lower() for s in sponsors])
    listed = lambda arr: F.coalesce(F.nullif(F.array_join(F.slice(arr, 1, 5), ", "), F.lit("")), F.lit("See study"))
    body = F.format_string(
        "NCT ID: %s\nStatus: %s\nPhase: %s\nSponsor: %s\nInterventions: %s\nConditions: %s\n\nSummary:\n%s",
        nct, F.coalesce("statusModule.overallStatus", F.lit("")), F.coalesce(F.nullif(F.array_join("designModule.phases", ", "), F.lit("")), F.lit("N/A")),
        F.concat(sponsor, F.when(rival, "  [VMS COMPANY]").otherwise("")), listed(F.filter("armsInterventionsModule.interventions.name", lambda x: x != "")), listed(F.col("conditionsModule.conditions")),
        F.coalesce(F.nullif(F.substring("descriptionModule.briefSummary", 1, 2000), F.lit("")), F.lit("No summary available.")),
    )
    title = F.coalesce(blank_to_null("identificationModule.briefTitle"), blank_to_null("identificationModule.officialTitle"), F.concat(F.lit("Trial "), nct))
    rows = p.where(F.coalesce(nct, F.lit("")) != "").select(F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"), title.alias("title"), body.alias("body_text"), now.alias("scraped_at"), rival.alias("competitive"))
    return as_raw(rows, "clinical_trials").join(rows.groupBy("url").agg(F.max("competitive").alias("competitive")), "url").dropDuplicates(["url"])


def registry_ids(pages: DataFrame, now: Column, most: int = 8) -> DataFrame:
    """Trial identifiers named in registry pages (html), at most ``most`` a page."""
    ids = F.slice(F.regexp_extract_all("html", F.lit(r"(?i)(ACTRN\d+|ISRCTN\d+|EUCTR[\w-]+|ChiCTR[\w-]+|CTRI/\S+)"), 1), 1, most)
    r = pages.select(F.explode(ids).alias("trial")).distinct()
    rows = r.select(F.concat(F.lit("https://trialsearch.who.int/Trial2.aspx?TrialID="), "trial").alias("url"), F.concat(F.lit("WHO ICTRP Trial: "), "trial").alias("title"), F.concat(F.lit("Trial ID: "), "trial").alias("body_text"), now.alias("scraped_at"))
    return as_raw(rows, "who_ictrp")


def sitemap_urls(maps: DataFrame, keywords: Sequence[str], k: int = 20) -> DataFrame:
    """(url, product_id): relevant addresses of XML sitemaps (body), highest number first."""
    loc = maps.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))
    number = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(url, '/buy/(\\d+)/', 1), '') as bigint)"), F.lit(0))
    return loc.where(any_of(F.lower("url"), keywords)).withColumn("product_id", number).orderBy(F.desc("product_id"), "url").limit(k)


def notable_papers(papers: DataFrame, cutoff: Column) -> DataFrame:
    """Recent papers, those cited ten times or more, and those never cited."""
    return papers.where((F.coalesce(F.col("date") >= cutoff, F.lit(False))) | (F.col("citations") >= 10) | (F.coalesce("citations", F.lit(0)) == 0))


def relevant(rows: DataFrame, keywords: Sequence[str], *columns: str) -> DataFrame:
    """Rows whose joined columns contain any keyword."""
    return rows.where(any_of(F.lower(F.concat_ws(" ", *columns)), keywords))


def watchlist_queries(spark: SparkSession, path: str, with_suffix: bool = True) -> DataFrame:
    """(ord, query) of the configured ingredients; ``_`` entries are comments."""
    w = spark.read.schema("query_suffix string, ingredients array<string>").option("multiLine", True).json(path)
    q = w.select(F.coalesce("query_suffix", F.lit("")).alias("suffix"), F.posexplode("ingredients").alias("ord", "name")).where("not startswith(name, '_')")
    full = F.when((F.col("suffix") == "") | F.col("name").contains(F.col("suffix")), F.col("name")).otherwise(F.concat_ws(" ", "name", "suffix"))
    return q.select("ord", (full if with_suffix else F.col("name")).alias("query"))


ENFORCEMENT = "results array<struct<product_description: string, recalling_firm: string, reason_for_recall: string, recall_number: string, recall_initiation_date: string, report_date: string, classification: string, country: string>>"


def enforcement_json(bodies: DataFrame, kind: str, default_facility: str, cutoff: Column) -> DataFrame:
    """Enforcement records of one endpoint as citation rows."""
    from ..operators.citations import first_category, infer_facility, infer_severity

    r = bodies.select("url", F.explode(F.from_json("body", ENFORCEMENT)["results"]).alias("r")).select(F.col("url").alias("query_url"), "r.*")
    r = r.withColumn("date", parse_date(F.coalesce("recall_initiation_date", "report_date"))).where(F.col("date").isNull() | (F.col("date") >= cutoff))
    title = F.substring(F.coalesce("product_description", F.lit("")), 1, 200)
    raw = F.concat_ws(" ", title, F.coalesce("reason_for_recall", F.lit("")), F.coalesce("recalling_firm", F.lit("")))
    number = F.trim(F.coalesce("recall_number", F.lit("")))
    url = F.when((number != "") & (F.upper(number) != "N/A"), F.concat(F.lit("https://www.accessdata.fda.gov/scripts/ires/?action=RecallAction&RecallNumber="), number)).otherwise(F.col("query_url"))
    found, cls = infer_facility(raw), F.lower(F.coalesce("classification", F.lit("")))
    facility = found if default_facility == "auto" else F.when(found != "General Pharma", found).otherwise(default_facility)
    severity = F.when(cls.contains("class i") & ~cls.contains("class ii"), "high").when(cls.contains("class ii"), "medium").otherwise(infer_severity(raw, F.lit(f"{kind}_enforcement")))
    key = F.when(number != "", number).otherwise(url)
    return r.select(
        short_hash(F.lit(f"FDA_{kind.upper()}"), key, bits=128, length=12).alias("id"), F.lit("FDA").alias("authority"), F.lit(f"{kind}_enforcement").alias("source_type"), F.col("recalling_firm").alias("company"), "date",
        first_category(raw).alias("category"), severity.alias("severity"), F.coalesce(F.nullif(F.substring("reason_for_recall", 1, 300), F.lit("")), title).alias("summary"), url.alias("url"),
        F.coalesce("country", F.lit("United States")).alias("country"), facility.alias("facility_type"), F.substring(raw, 1, 500).alias("violation_details"),
    )


def running_heading(rows: DataFrame) -> DataFrame:
    """Rows (doc, pos, heading, text): each takes the last heading before it in its document."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last("heading", ignorenulls=True).over(w))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
            self.href = None


def _links(html: str) -> list[tuple]:
    p = _Links()
    p.feed(html)
    return p.found


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) of every anchor with an address, in page order."""
    bound_batches(pages.sparkSession)
    walk = rows_of_pages(_links, [("href", pa.string()), ("text", pa.string())])
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(walk, "page_id long, pos int, href string, text string")


def hub_links(links: DataFrame, pattern: str, blocked: Sequence[str], least: int = 10) -> DataFrame:
    """Links to notices: address pattern, no navigation text, text long enough; first of each address."""
    ok = links.where(F.col("href").rlike(pattern) & (F.length("text") >= least) & ~F.lower("text").isin(*blocked))
    return ok.groupBy("href").agg(F.min_by(F.struct("page_id", "pos", "text"), F.struct("page_id", "pos")).alias("x")).select("href", "x.*")
