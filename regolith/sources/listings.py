"""HTML listings, XML literature, preprint and retail bodies to raw notices."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import any_of, parse_date
from .batches import bound_batches, rows_of_pages
from .parsers import as_raw, canonical_url, text_of

BLOCKS = ("li", "article", "tr")
DAY_MONTH = r"\b(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4})\b"
ISO = r"\b(\d{4}-\d{2}-\d{2})\b"


class _Blocks(HTMLParser):
    """Innermost list items, articles and table rows with their first link and stated date."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[str | None, str, str, str | None, str | None, str | None]] = []
        self.open: list[dict] = []
        self.heading: str | None = None
        self.into: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("h2", "h3", "h4"):
            self.into = []
        if tag in BLOCKS:
            self.open.append({"href": None, "text": [], "link": [], "in": False, "time": None, "class": None, "dated": None})
        if not self.open:
            return
        b = self.open[-1]
        if tag == "a" and b["href"] is None and a.get("href"):
            b["href"], b["in"] = a["href"], True
        if tag == "time":
            b["time"] = b["time"] or a.get("datetime")
        if "date" in (a.get("class") or "").lower():
            b["dated"] = tag

    def handle_data(self, data):
        if self.into is not None:
            self.into.append(data)
        if self.open:
            b = self.open[-1]
            b["text"].append(data)
            if b["in"]:
                b["link"].append(data)
            if b["dated"] and b["class"] is None and data.strip():
                b["class"] = data.strip()

    def handle_endtag(self, tag):
        if tag in ("h2", "h3", "h4") and self.into is not None:
            self.heading, self.into = " ".join("".join(self.into).split()) or self.heading, None
        if not self.open:
            return
        b = self.open[-1]
        if tag == "a":
            b["in"] = False
        if tag == b["dated"]:
            b["dated"] = None
        if tag in BLOCKS:
            self.open.pop()
            squeeze = lambda x, by="": " ".join(by.join(x).split())
            if b["href"]:
                self.done.append((b["href"], squeeze(b["link"]), squeeze(b["text"], " "), b["time"], b["class"], self.heading))


def _blocks(html: str) -> list[tuple]:
    p = _Blocks()
    p.feed(html)
    return p.done


def html_listing(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, title, text, date, section): one row a linked block.

    The date comes from the first that parses: a time element, an element with a date class, a
    day-month-year or an ISO date in the block's text.  Undated blocks stay."""
    bound_batches(pages.sparkSession)
    walk = rows_of_pages(_blocks, [(n, pa.string()) for n in ("href", "title", "text", "time_attr", "date_text", "section")])
    rows = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(walk, "page_id long, pos int, href string, title string, text string, time_attr string, date_text string, section string")
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    date = F.coalesce(parse_date("time_attr"), parse_date("date_text"), parse_date(found(DAY_MONTH)), parse_date(found(ISO)))
    return rows.withColumn("date", date).drop("time_attr", "date_text")


def listing_notices(pages: DataFrame, authority: str, base_url: str, cutoff: Column, now: Column, keywords: Sequence[str] = (), blocked: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Notices of an authority's listing pages: recent or undated, relevant, first of each address."""
    r = html_listing(pages).where((F.col("date").isNull() | (F.col("date") >= cutoff)) & (F.length("title") >= least) & ~F.lower("title").isin(*blocked))
    if keywords:
        r = r.where(any_of(F.lower(F.concat_ws(" ", "title", "text")), keywords))
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base_url.rstrip("/")), F.when(F.col("href").startswith("/"), "").otherwise("/"), "href"))
    first = r.groupBy(url.alias("url")).agg(F.min_by(F.struct("title", "text", "date", "section"), F.struct("page_id", "pos")).alias("x")).select("url", "x.*")
    body = F.concat_ws("\n", F.concat(F.lit("Published: "), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown date"))), F.concat(F.lit("Section: "), "section"), "text")
    return as_raw(first.select("url", "title", body.alias("body_text"), now.alias("scraped_at")), authority)


ARTICLE = (
    "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string>>>,"
    " AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>>"
)


def literature_xml(spark: SparkSession, path: str, now: Column, authority: str = "pubmed") -> DataFrame:
    """Article records of literature XML files."""
    d = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path).select("MedlineCitation.*")
    a = F.slice(F.filter(F.coalesce("Article.AuthorList.Author", F.array()), lambda x: F.coalesce(x["LastName"], F.lit("")) != ""), 1, 5)
    names = F.array_join(F.transform(a, lambda x: F.trim(F.concat_ws(" ", x["LastName"], x["ForeName"]))), "; ")
    issue = F.col("Article.Journal.JournalIssue.PubDate")
    mesh = F.array_join(F.slice(F.transform(F.coalesce("MeshHeadingList.MeshHeading", F.array()), lambda m: m["DescriptorName"]), 1, 10), "; ")
    body = F.format_string(
        "PMID: %s\nAuthors: %s\nJournal: %s\nPublication Date: %s\nMeSH Terms: %s\n\nAbstract:\n%s",
        F.col("PMID"), F.concat(names, F.when(F.size(a) == 5, " et al.").otherwise("")), F.coalesce("Article.Journal.Title", F.lit("")), F.concat_ws("-", issue["Year"], issue["Month"]),
        F.coalesce(F.nullif(mesh, F.lit("")), F.lit("None")), F.coalesce(F.nullif(F.array_join("Article.Abstract.AbstractText", " "), F.lit("")), F.lit("No abstract available.")),
    )
    url = F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "PMID", F.lit("/"))
    return as_raw(d.select(url.alias("url"), F.coalesce("Article.ArticleTitle", F.concat(F.lit("PubMed PMID "), "PMID")).alias("title"), body.alias("body_text"), now.alias("scraped_at")), authority)


PREPRINTS = "collection array<struct<doi: string, title: string, abstract: string, date: string, category: string, authors: string>>"


def preprints_json(bodies: DataFrame, keywords: Sequence[str], now: Column, most: int = 500) -> DataFrame:
    """Preprint pages (server, page, body): the first ``most`` of each server, relevant ones."""
    from pyspark.sql import Window

    r = bodies.select("server", "page", F.posexplode(F.from_json("body", PREPRINTS)["collection"]).alias("pos", "r")).select("server", "page", "pos", "r.*")
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("server").orderBy("page", "pos"))).where(F.col("k") <= most)
    r = r.where(any_of(F.lower(F.concat_ws(" ", "title", "abstract")), keywords))
    body = F.format_string("Server: %s\nCategory: %s\nAuthors: %s\nDate: %s\n\nAbstract:\n%s", "server", F.coalesce("category", F.lit("")), F.coalesce("authors", F.lit("")), F.coalesce("date", F.lit("")), F.coalesce("abstract", F.lit("")))
    return as_raw(r.select(canonical_url(F.lit(""), F.col("doi"), F.lit("")).alias("url"), "title", body.alias("body_text"), now.alias("scraped_at")), "biorxiv").dropDuplicates(["source_id"])


def product_pages(pages: DataFrame, now: Column, most: int = 30) -> DataFrame:
    """Products in pages' embedded JSON (``application/ld+json``), first of each product id."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1))
    get = lambda p: F.get_json_object("j", p)
    r = pages.select("page_id", "url", block.alias("j")).where(get("$['@type']") == "Product")
    r = r.select("page_id", "url", get("$.sku").alias("sku"), get("$.name").alias("name"), F.coalesce(get("$.brand.name"), get("$.brand")).alias("brand"), get("$.offers.price").alias("price"), F.substring(text_of(get("$.description")), 1, 1500).alias("about")).where("name is not null")
    first = r.groupBy(F.coalesce("sku", "url").alias("k")).agg(F.min_by(F.struct("page_id", "url", "name", "brand", "price", "about"), "page_id").alias("x")).select("x.*").orderBy("page_id").limit(most)
    body = F.concat_ws("\n", F.concat(F.lit("Brand: "), "brand"), F.concat(F.lit("Price: AU$"), "price"), "about")
    return as_raw(first.select("url", F.col("name").alias("title"), body.alias("body_text"), now.alias("scraped_at")), "retail")
