"""Register entries and the journal cascade, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import any_of, parse_date
from ..operators.facets import keep_first
from .parsers import as_raw, text_of

# Field layouts, result links and the words that make an entry relevant
LABELLED = r"""(?is)<(\w+)\b[^>]*class=["'][^"']*field(?:__|-)label[^"']*["'][^>]*>(.*?)</\1>\s*<(\w+)\b[^>]*>(.*?)</\3>"""
TABLED = r"(?is)<tr\b[^>]*>\s*<th\b[^>]*>(.*?)</th>\s*<td\b[^>]*>(.*?)</td>"
STATED = r"(?i)(ARTG (?:ID|Name|Date)|Product name|Sponsor|Therapeutic good type|Registration Type)[ \t]*\n?[ \t]*([^\n]{3,100})"
RESULT_LINK = r"""(?i)href=["']((?:https://www\.efsa\.europa\.eu)?/en/(?:efsajournal|publications?|scientific-opinion)[^"'?#]+)["']"""
RESULT_TITLE = r"""(?i)<h[23][^>]*class=["'][^"']*(?:title|heading)[^"']*["'][^>]*>([^<]{10,250})"""
FEED_WORDS = ["supplement", "vitamin", "mineral", "herbal", "botanical", "nutrient", "novel food", "food additive"]
JOURNAL_SITE = "https://www.efsa.europa.eu"


def entry_links(pages: DataFrame, base: str) -> DataFrame:
    """(entry, url): register entries that listing pages link to, once each."""
    ids = pages.select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href=["']/resources/artg/(\d+)["']"""), 1))).alias("entry")).distinct()
    return ids.withColumn("url", F.concat(F.lit(f"{base}/resources/artg/"), "entry"))


def _fields(html: Column, pattern: str, label: int, value: int) -> Column:
    key = lambda x: F.regexp_replace(F.lower(F.regexp_replace(text_of(x), ":+$", "")), " ", "_")
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), label).alias("l"), F.regexp_extract_all(html, F.lit(pattern), value).alias("v"))
    return F.transform(pairs, lambda p: F.struct(key(p["l"]).alias("k"), text_of(p["v"]).alias("v")))


def register_entries(pages: DataFrame, cutoff: Column, now: Column, authority: str = "artg") -> DataFrame:
    """Notices of medicine entries (entry, url, html) that are recent or undated.

    Fields are label and value elements, else table rows, else labels in the main text; of equal labels
    the last counts."""
    main = F.regexp_extract("html", r"""(?is)<(main|div|section)\b[^>]*(?:<main|role=["']?main|id=["']content["']|class=["']content["'])?[^>]*>(.*)</\1>""", 2)
    plain = F.regexp_replace(F.regexp_replace(main, r"(?i)<br\s*/?>|</(?:p|div|li)>", "\n"), r"<[^>]*>", "")
    stated = F.transform(
        F.arrays_zip(F.regexp_extract_all(plain, F.lit(STATED), 1).alias("l"), F.regexp_extract_all(plain, F.lit(STATED), 2).alias("v")),
        lambda p: F.struct(F.regexp_replace(F.lower(p["l"]), " ", "_").alias("k"), F.trim(p["v"]).alias("v")),
    )
    first, second = _fields(F.col("html"), LABELLED, 2, 4), _fields(F.col("html"), TABLED, 1, 2)
    # a generator between the steps: each layout is searched once, not once a field
    once = lambda c: F.explode(F.array(c))
    d = pages.select("entry", "url", F.coalesce("html", F.lit("")).alias("html"))
    d = d.select("*", once(F.struct(first.alias("a"), second.alias("b"))).alias("x")).select("entry", "url", once(F.when(F.size("x.a") > 0, F.col("x.a")).when(F.size("x.b") > 0, F.col("x.b")).otherwise(stated)).alias("f"))

    def last(name: str) -> Column:
        return F.nullif(F.get(F.reverse(F.filter("f", lambda x: x["k"] == name)), 0)["v"], F.lit(""))

    get = lambda *names: F.coalesce(*map(last, names), F.lit(""))
    names = {"registration_type": ["registration_type"], "good_type": ["therapeutic_good_type"], "date_text": ["artg_date"], "product": ["product_name", "artg_name"], "sponsor": ["sponsor"], "formulation": ["formulation"], "active": ["active_ingredients", "ingredients"], "details": ["product_details"]}
    d = d.select("entry", "url", *[get(*v).alias(k) for k, v in names.items()])
    kind = F.lower(F.concat_ws(" ", "registration_type", "good_type"))
    d = d.where(any_of(kind, ["medicine", "complementary"])).withColumn("date", parse_date(F.substring("date_text", 1, 20)))
    d = d.where(F.col("date").isNull() | (F.col("date") >= cutoff))
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    body = F.concat_ws(
        "\n", F.concat(F.lit("ARTG ID: "), "entry"), F.concat(F.lit("Date listed: "), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("unknown date"))), F.concat(F.lit("Sponsor: "), "sponsor"),
        F.concat(F.lit("Registration type: "), "registration_type"), F.concat(F.lit("Therapeutic good type: "), "good_type"),
        line("Formulation", F.col("formulation")), line("Active ingredients", F.col("active")), line("Product details", F.substring("details", 1, 500)),
    )
    return as_raw(d.select("url", F.concat(F.col("product"), F.lit(" ("), "entry", F.lit(")")).alias("title"), body.alias("body_text"), now.alias("scraped_at")), authority)


_ITEM = ", ".join(f"{c}: string" for c in ("title", "name", "url", "link", "doi", "abstract", "summary", "description", "publicationDate", "date"))
JOURNAL = f"hits struct<hits: array<struct<_source: struct<{_ITEM}>, {_ITEM}>>>, results array<struct<{_ITEM}>>"


def journal_cascade(answers: DataFrame, searches: DataFrame, feeds: DataFrame, now: Column, most: int = 20) -> DataFrame:
    """Journal notices of terms (ord, term): JSON answers (…, body), the search page (…, html) of terms whose
    answer has no item, and relevant items of feeds (html); the first of each address in that order."""
    j = answers.select("ord", "term", F.from_json("body", JOURNAL).alias("j"))
    names = [x.split(":")[0] for x in _ITEM.split(", ")]
    source = F.transform("j.hits.hits", lambda h: F.coalesce(h["_source"], F.struct(*[h[n].alias(n) for n in names])))
    items = j.select("ord", "term", F.when(F.size(source) > 0, source).otherwise(F.col("j.results")).alias("items"))
    flat = items.select("ord", "term", F.posexplode("items").alias("pos", "x"))
    pick = lambda *n: F.coalesce(*[F.nullif(F.col(f"x.{c}"), F.lit("")) for c in n], F.lit(""))
    full = lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(JOURNAL_SITE), u))
    url, title = pick("url", "link", "doi"), F.trim(pick("title", "name"))
    about = F.coalesce(F.nullif(F.substring(pick("abstract", "summary", "description"), 1, 2000), F.lit("")), F.lit("See full publication at EFSA."))
    body = F.format_string("Source: EFSA Journal / EFSA Scientific Opinion\nURL: %s\nPublished: %s\nSearch term: %s\n\n%s", full(url), pick("publicationDate", "date"), F.col("term"), about)
    answered = flat.where((url != "") & (title != "")).select(F.lit(0).alias("last"), "ord", "pos", full(url).alias("url"), title.alias("title"), body.alias("body_text"))

    silent = searches.join(flat.select("ord").distinct(), "ord", "left_anti")
    squeeze = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    links = silent.select("ord", "term", F.slice(F.regexp_extract_all("html", F.lit(RESULT_LINK), 1), 1, most).alias("links"), F.regexp_extract_all("html", F.lit(RESULT_TITLE), 1).alias("titles"))
    links = links.select("ord", "term", "titles", F.posexplode("links").alias("pos", "href"))
    named = F.coalesce(F.nullif(squeeze(F.get("titles", F.col("pos"))), F.lit("")), F.concat(F.lit("EFSA Publication: "), "term"))
    body = F.format_string("Source: EFSA Publications\nURL: %s\nSearch term: %s\nAuthority: European Food Safety Authority", full(F.col("href")), F.col("term"))
    searched = links.select(F.lit(0).alias("last"), "ord", "pos", full(F.col("href")).alias("url"), named.alias("title"), body.alias("body_text"))

    entry = feeds.select(F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<item>(.*?)</item>"), 1)).alias("pos", "x"))
    text = lambda tag: F.trim(F.regexp_extract("x", rf"<{tag}>(?:<!\[CDATA\[)?([^<\]]+)(?:\]\]>)?</{tag}>", 1))
    entry = entry.select("pos", F.trim(F.regexp_extract("x", "<link>([^<]+)</link>", 1)).alias("url"), text("title").alias("title"), text("description").alias("about"))
    entry = entry.where((F.col("url") != "") & (F.col("title") != "")).where(any_of(F.lower(F.concat("title", "about")), FEED_WORDS))
    body = F.format_string("Source: EFSA Scientific Output\nURL: %s\n\n%s", "url", F.substring("about", 1, 2000))
    fed = entry.select(F.lit(1).alias("last"), F.lit(0).cast("long").alias("ord"), "pos", "url", "title", body.alias("body_text"))
    rows = keep_first(answered.unionByName(searched).unionByName(fed), F.col("url"), F.col("last"), F.col("ord"), F.col("pos"))
    return as_raw(rows.withColumn("scraped_at", now), "efsa")
