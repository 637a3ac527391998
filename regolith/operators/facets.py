"""Faceted filters, display keys and labels over citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import any_of, blank_to_null, icase

SEARCHED = ["summary", "category", "primary_gmp_category", "failure_mode", "company", "authority", "source_type", "facility_type", "violation_details", "decision_summary"]


@dataclass(frozen=True)
class Facets:
    """Options of a faceted search; ``all``, blank and None do not restrict."""

    noise_filter: bool = True
    authority: str = "all"
    severity: str = "all"
    source_type: str = "all"
    facility_type: str = "all"
    category: str | None = None
    di_capa: bool = False
    company: str = ""
    query: str = ""
    query_fields: tuple[str, ...] | None = None
    date_from: str = ""
    date_to: str = ""
    priority: str | tuple[str, ...] = "all"
    failure_mode: str = ""


def _text(c: DataFrame, *names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names if n in c.columns]))


def clean_ingredient(c: Column) -> Column:
    """At least three characters, not a placeholder, with a letter a-z."""
    k = F.lower(F.trim(c))
    return (F.length(k) >= 3) & ~k.isin(*R.INVALID_INGREDIENT) & k.rlike("[a-z]")


def is_di_capa(c: DataFrame) -> Column:
    return any_of(_text(c, "category", "summary", "violation_details"), R.DI_CAPA)


def is_low_value(c: DataFrame) -> Column:
    return any_of(_text(c, "title", "summary"), R.NOISE)


def is_valid_enforcement(c: DataFrame) -> Column:
    summary = F.trim(F.coalesce("summary", F.lit("")))
    text = F.lower(F.concat(summary, F.lit(" "), F.coalesce("category", F.lit("")) if "category" in c.columns else F.lit("")))
    starts = F.lit(False)
    for p in R.JUNK_START:
        starts = starts | text.startswith(p)
    words = F.size(F.filter(F.split(summary, r"\s+"), lambda w: w != ""))
    return F.col("source_type").isin(*R.ENFORCEMENT_TYPES) & ~F.lower(summary).isin(*R.JUNK_EXACT) & ~starts & ((words >= 5) | any_of(text, R.ACTION_VERBS))


def conditions(c: DataFrame, f: Facets) -> dict[str, Column]:
    """The restricting options by name; equality facets reach the scan as pushed filters."""
    out: dict[str, Column] = {}
    if f.noise_filter:
        out["noise_filter"] = ~is_low_value(c) & is_valid_enforcement(c)
        if "is_noise" in c.columns:
            out["noise_filter"] = out["noise_filter"] & ~F.coalesce("is_noise", F.lit(False))
    for column, value in (("authority", f.authority), ("source_type", f.source_type), ("facility_type", f.facility_type)):
        if value != "all":
            out[column] = F.col(column) == value
    if f.severity != "all":
        out["severity"] = F.lower("severity") == f.severity
    if f.category:
        legacy = F.coalesce(blank_to_null("category"), F.lit("Other")) if "category" in c.columns else F.lit("Other")
        out["category"] = (legacy == f.category) | (F.coalesce("primary_gmp_category", F.lit("")) == f.category)
    if f.di_capa:
        out["di_capa"] = is_di_capa(c)
    if f.company:
        out["company"] = _text(c, "company", "cluster_label", "facility_type").contains(f.company.lower())
    if f.priority != "all":
        out["priority"] = F.col("priority").isin(*([f.priority] if isinstance(f.priority, str) else f.priority))
    if f.failure_mode:
        out["failure_mode"] = F.col("failure_mode") == f.failure_mode
    if f.query:
        names = [n for n in (f.query_fields or SEARCHED) if n in c.columns]
        hay = F.lower(F.concat_ws(" ", *(map(blank_to_null, names) if f.query_fields is None else [F.coalesce(F.col(n), F.lit("")) for n in names])))
        out["query"] = hay.contains(f.query.lower())
    for name, bound, test in (("date_from", f.date_from, lambda d: F.col("date") >= d), ("date_to", f.date_to, lambda d: F.col("date") <= d)):
        if bound:
            out[name] = F.col("date").isNull() | test(F.lit(bound).cast("date"))
    return out


def predicate(c: DataFrame, f: Facets) -> Column:
    """The conjunction of the options."""
    out = F.lit(True)
    for x in conditions(c, f).values():
        out = out & x
    return out


def base_pool(c: DataFrame) -> DataFrame:
    """All rows that the noise filter leaves, whatever facets are set."""
    return c.where(predicate(c, Facets()))


#: Facets that are offered with counts, and the column whose values they have.
COUNTED = {"authority": "authority", "source_type": "source_type", "facility_type": "facility_type", "severity": "severity", "category": "primary_gmp_category", "priority": "priority", "failure_mode": "failure_mode"}


def facet_counts(c: DataFrame, f: Facets, most: int = 1000) -> DataFrame:
    """(facet, value, n): for each facet the rows by value that meet all options but the facet's own.

    One scan: a row has a bit for each condition that it fails.  It counts in every facet if it fails none, in
    one facet alone if it fails that one's condition, and else nowhere.  At most ``most`` values a facet."""
    tests = conditions(c, f)
    failed = F.lit(0)
    bit = {}
    for i, (name, test) in enumerate(tests.items()):
        bit[name] = 1 << i
        failed = failed.bitwiseOR(F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1 << i))
    rows = c.withColumn("_failed", failed).where(F.bit_count("_failed") <= 1)
    own = lambda name: F.col("_failed").isin(0, bit.get(name, 0))
    value = lambda column: F.nullif(F.lower(column) if column == "severity" else F.col(column), F.lit(""))
    pairs = F.array_compact(F.array(*[F.when(own(name) & value(column).isNotNull(), F.struct(F.lit(name).alias("facet"), value(column).alias("value"))) for name, column in COUNTED.items()]))
    g = rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    top = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return g.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most).drop("rank")


def search(c: DataFrame, f: Facets, sort: str = "date", ascending: bool = True) -> DataFrame:
    """Filtered rows; the default order is ascending with undated rows first."""
    rows = c.where(predicate(c, f))
    return rows.orderBy(F.asc_nulls_first(sort) if ascending else F.desc_nulls_last(sort), "id")


def match_count(c: DataFrame, f: Facets) -> DataFrame:
    return c.agg(F.count_if(predicate(c, f)).alias("n"))


def first_nonempty(c: DataFrame, options: list[tuple[str, Column]]) -> DataFrame:
    """(choice, n) of the first option with a match, found in one pass."""
    counts = c.agg(*[F.count_if(p).alias(f"n{i}") for i, (_, p) in enumerate(options)])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") > 0, F.struct(F.lit(name).alias("choice"), F.col(f"n{i}").alias("n"))) for i, (name, _) in enumerate(options)])
    return counts.select(pick.alias("p")).where("p is not null").select("p.*")


def summary_family(text: Column) -> Column:
    """Code of boilerplate summary texts, null for others."""
    r = lambda p: text.rlike(icase(p))
    return (
        F.when(r("family smoking prevention|tobacco control act"), "tobacco_compliance")
        .when(r("cgmp") & r("adulterat"), "cgmp_adulterated")
        .when(r("adulterated.*misbranded|misbranded.*adulterated"), "adulterated_misbranded")
        .when(r("adulterated") & ~r("cgmp"), "adulterated_misbranded")
        .when(r("unapproved new drug"), "unapproved_new_drug")
        .when(r("foreign supplier verification|fsvp"), "fsvp")
        .when(r("import alert|detention without physical examination"), "import_alert_dwpe")
    )


def display_key(c: DataFrame) -> Column:
    raw = F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("violation_details", F.lit("")))
    part = F.coalesce(summary_family(raw), F.substring(F.lower(F.trim(F.coalesce("summary", F.lit("")))), 1, 100))
    fill = lambda n: F.coalesce(F.col(n), F.lit("")) if n in c.columns else F.lit("")
    return F.concat_ws("|", fill("authority"), fill("source_type"), fill("category"), F.lower(fill("company")), part)


def display_issue() -> Column:
    """Specific mode, then category, then first specific secondary category, else Unclassified."""
    fm, pgc, status = F.coalesce("failure_mode", F.lit("")), F.coalesce("primary_gmp_category", F.lit("")), F.col("classification_status")
    second = F.get(F.filter("secondary_gmp_categories", lambda s: ~s.isin(*R.BROAD)), 0)
    return (
        F.when(~fm.isin("", "insufficient_detail") & (F.col("failure_mode_confidence") >= 0.6), F.regexp_replace(fm, "_", " "))
        .when(~pgc.isin(*R.BROAD), F.when(status == "provisional", F.concat(F.lit("Provisional: "), pgc)).otherwise(pgc))
        .otherwise(F.coalesce(second, F.lit("Unclassified")))
    )


def base_issue(issue: Column) -> Column:
    return F.regexp_replace(issue, "^Provisional: ", "")


def display_category() -> Column:
    cat, status = F.coalesce("primary_gmp_category", F.lit("")), F.col("classification_status")
    return F.when(cat.isin("", R.NO_DETAIL), cat).when(status == "unconfirmed", "Limited detail").when(status == "provisional", F.concat(F.lit("Provisional: "), cat)).otherwise(cat)


def evidence_status() -> Column:
    s = F.col("classification_status")
    return F.when(s == "confirmed", "Confirmed").when(s == "provisional", "Provisional").when(s == "unconfirmed", "Limited evidence").otherwise("Unknown")


def url_quality(url: Column) -> Column:
    u = F.lower(url)
    return F.when(F.coalesce(url, F.lit("")) == "", "missing").when(u.startswith("https://api.fda.gov"), "api_endpoint").when(u.contains("accessdata.fda.gov/scripts/ires"), "search_landing").otherwise("direct_detail")


def recall_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)[?&]RecallNumber=([^&#]+)", 1), F.lit(""))


def keep_first(c: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order, found by one partial aggregate."""
    rows = c.select(key.alias("_k"), F.struct(*order).alias("_o"), F.struct(*c.columns).alias("_r"))
    return rows.groupBy("_k").agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def collapse(c: DataFrame) -> DataFrame:
    """A row per cluster: its primary, or its first row in rec_no order if that was filtered out."""
    return first_of(c, F.coalesce("cluster_id", "id"))


def first_of(c: DataFrame, *keys: Column) -> DataFrame:
    """A row per key: its primary that comes first, else its first row in rec_no order, and how many others it has.

    The row's number is found by aggregates of plain numbers and met by a join, so whole rows are neither sorted nor kept by key."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    own = F.when(F.col("cluster_primary"), F.col("rec_no"))
    g = c.select("rec_no", "cluster_primary", *[k.alias(n) for n, k in named.items()]).groupBy(*named).agg(F.coalesce(F.min(own), F.min("rec_no")).alias("_first"), F.count("*").alias("_n"))
    g = g.select("_first", (F.col("_n") - 1).alias("other_members"))
    return c.join(g.hint("shuffle_hash"), c["rec_no"] == g["_first"]).drop("_first")


def display_groups(c: DataFrame) -> DataFrame:
    """First row and count of each (authority, source type, month, facility, category)."""
    rows = c.select("rec_no", "authority", "source_type", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("")).alias("month"), F.lower(F.coalesce("facility_type", F.lit(""))).alias("facility"), F.lower("primary_gmp_category").alias("category"))
    return rows.groupBy("authority", "source_type", "month", "facility", "category").agg(F.min("rec_no").alias("rec_no"), F.count("*").alias("n"))


def before_first(rows: DataFrame, key: str, order: str, stop: Column) -> DataFrame:
    """Rows of each key that come before its first row where ``stop`` holds: the place is one
    partial minimum a key, so no key is sorted in one task."""
    at = rows.where(stop).groupBy(key).agg(F.min(order).alias("_stop"))
    return rows.join(at, key, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")
