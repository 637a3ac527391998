"""Rankings, roll-ups and counts for overview pages and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .facets import base_issue, display_issue

SKIP_MODE = ["", "insufficient_detail", "other", "unknown"]
SKIP_CATEGORY = ["", "Other", R.NO_DETAIL, "GMP violations"]
SKIP_COMPANY = ["unknown", "n/a", "na", "various", "multiple", "other", "—", "-", ""]


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, key: str, k: int, order: str) -> DataFrame:
    """Most common values, ties by first appearance in ``order``."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return g.orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def priority_counts() -> list[Column]:
    return [F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P1", "P2", "P3")]


def risk_ranking(c: DataFrame, k: int = 6) -> DataFrame:
    """Cluster primaries by mode (confident) or category, scored by priority, evidence, volume."""
    fm, cat = F.coalesce("failure_mode", F.lit("")), F.coalesce("primary_gmp_category", F.lit(""))
    key = F.when(~fm.isin(*SKIP_MODE) & (F.col("failure_mode_confidence") >= 0.6), F.concat(F.lit("fm:"), fm)).when(~cat.isin(*SKIP_CATEGORY) & (F.col("classification_status") != "unconfirmed"), F.concat(F.lit("cat:"), cat))
    rows = c.where("cluster_primary").where(~F.col("source_type").isin(*R.NOT_ENFORCEMENT)).withColumn("key", key).where("key is not null")
    g = rows.groupBy("key").agg(F.count("*").alias("total"), *priority_counts(), F.count_if(F.col("classification_status") == "confirmed").alias("confirmed"), F.sum("cluster_size").alias("cluster_rows"))
    score = F.col("p1") * 1000 + F.col("p2") * 50 + F.col("p3") * 5 + F.col("confirmed") * 2 + F.least(F.col("total"), F.lit(10))
    return g.withColumn("score", score).orderBy(F.desc("score"), "key").limit(k)


def issue_cards(c: DataFrame) -> DataFrame:
    """Cluster primaries per display issue, provisional variants merged."""
    issue = display_issue()
    rows = c.where("cluster_primary").withColumn("issue", base_issue(issue)).withColumn("prov", issue.startswith("Provisional: "))
    prose = F.coalesce("decision_summary", F.lit("")) != ""
    g = rows.groupBy("issue").agg(F.count("*").alias("total"), F.sum("cluster_size").alias("raw_rows"), *priority_counts()[:2], F.count_if(prose).alias("with_summary"), F.max("prov").alias("has_provisional"))
    return g.withColumn("score", F.col("p1") * 5 + F.col("p2") * 2 + F.col("with_summary")).orderBy(F.col("issue") == "Unclassified", F.desc("score"), "issue")


def alert_groups(c: DataFrame) -> DataFrame:
    """P1 and P2 that is not unconfirmed, per issue; with a P1 or two confirmed."""
    strong = (F.col("priority") == "P1") | ((F.col("priority") == "P2") & (F.col("classification_status") != "unconfirmed"))
    rows = c.where(strong).withColumn("issue", base_issue(display_issue())).where("issue <> 'Unclassified'")
    g = rows.groupBy("issue").agg(F.count("*").alias("total"), *priority_counts()[:2], F.count_if(F.col("classification_status") == "confirmed").alias("confirmed"), F.count_distinct("authority").alias("authorities"))
    return g.where("p1 >= 1 or confirmed >= 2").orderBy(F.desc("p1"), F.desc("p2"), F.desc("confirmed"), F.desc("total"), "issue")


def company_rollup(c: DataFrame) -> DataFrame:
    """Companies with three records, a P1, or two categories; modal facility by first use."""
    co = F.trim(F.coalesce(F.nullif("company", F.lit("")), F.nullif("cluster_label", F.lit("")), F.lit("")))
    rows = c.withColumn("name", co).where(~F.lower("name").isin(*SKIP_COMPANY))
    g = rows.groupBy("name").agg(F.count("*").alias("total"), *priority_counts()[:2], F.count_distinct("authority").alias("authorities"), F.count_distinct("primary_gmp_category").alias("categories"), F.count_distinct("cluster_id").alias("clusters"), F.max("date").alias("latest"))
    by = rows.groupBy("name", "facility_type").agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    modal = by.groupBy("name").agg(F.max_by("facility_type", F.struct("n", -F.col("first"))).alias("facility_type"))
    return g.where("total >= 3 or p1 >= 1 or categories >= 2").join(modal, "name").withColumn("weight", F.col("p1") * 3 + F.col("p2") + F.col("total"))


def facility_rollup(c: DataFrame) -> DataFrame:
    """Records per facility type and its most frequent category."""
    by = c.groupBy("facility_type", "primary_gmp_category").agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    return by.groupBy("facility_type").agg(F.sum("n").alias("total"), F.max_by("primary_gmp_category", F.struct("n", -F.col("first"))).alias("top_category"))


def heat_map(c: DataFrame, authorities: list[str], k: int = 10) -> DataFrame:
    """Top categories by authority, one column each."""
    top = top_counts(c, "primary_gmp_category", k, "rec_no").select("primary_gmp_category")
    return c.join(F.broadcast(top), "primary_gmp_category", "left_semi").groupBy("primary_gmp_category").agg(*[F.count_if(F.col("authority") == a).alias(a.lower()) for a in authorities])


def patterns(c: DataFrame, least: int = 3) -> DataFrame:
    """Companies and categories with at least ``least`` records; a category hides an equal company."""
    co = c.where("coalesce(company, '') <> ''").groupBy(F.col("company").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    cat = c.where("coalesce(primary_gmp_category, '') <> ''").groupBy(F.col("primary_gmp_category").alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return co.join(cat.select("name"), "name", "left_anti").select("name", F.lit("company").alias("kind"), "n").unionByName(cat.select("name", F.lit("category").alias("kind"), "n"))


def kpis(c: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    return c.agg(F.count("*").alias("total"), *priority_counts(), F.count_if(F.lower("severity") == "high").alias("high"), F.count_if(F.col("classification_status") == "confirmed").alias("confirmed"), F.count_if("cluster_primary").alias("primaries"), F.count_distinct("authority").alias("authorities"))


def changed(c: DataFrame, key: str, as_of: str, days: int, least_prior: int = 0, least_delta: int = 0) -> DataFrame:
    """Counts of a window and the equally long one before it, with their difference."""
    d = lambda n: F.date_sub(F.lit(as_of).cast("date"), n)
    rows = c.where(F.col("date") >= d(2 * days))
    g = rows.groupBy(key).agg(F.count_if(F.col("date") >= d(days)).alias("curr"), F.count_if(F.col("date") < d(days)).alias("prior"))
    return g.withColumn("delta", F.col("curr") - F.col("prior")).where((F.col("prior") > least_prior) & (F.abs("delta") > least_delta))


def risk_impact(count: Column, high: Column) -> Column:
    share = F.when(count > 0, high / count).otherwise(0.0)
    return F.when((share > 0.4) | (high > 5), "Critical").when((share > 0.2) | (high > 2), "High").otherwise("Watch")


def volume_bucket(n: Column) -> Column:
    return F.when(n >= 200, "Very High").when(n >= 100, "High").when(n >= 40, "Moderate").when(n >= 10, "Low").otherwise("Minimal")


def movement(curr: Column, prev: Column) -> Column:
    d = curr - prev
    return F.when((curr == 0) & (prev == 0), "").when(prev == 0, "new this period").when(curr == 0, "no recent activity").when(F.abs(d) <= 2, "stable").when(d > 0, F.concat(F.lit("+"), d.cast("string"), F.lit(" vs prior"))).otherwise(F.concat(d.cast("string"), F.lit(" vs prior")))


def evidence_audit(c: DataFrame) -> DataFrame:
    """Counts of evidence and status per category."""
    return c.groupBy("primary_gmp_category").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("enriched_text", F.lit("")) != "").alias("with_enriched_text"),
        F.count_if(F.size("category_evidence") > 0).alias("with_evidence"),
        F.count_if(F.size("category_evidence") == 0).alias("no_evidence"),
        F.count_if((F.col("classification_confidence") < 0.5) & (F.col("failure_mode_confidence") < 0.5)).alias("low_confidence"),
        *[F.count_if(F.col("classification_status") == s).alias(s) for s in ("confirmed", "provisional", "unconfirmed")],
    )


def funnel(c: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step of a chain of filters, in one pass."""
    acc, cols = F.lit(True), []
    for name, p in steps:
        acc = acc & p
        cols.append(F.count_if(acc).alias(name))
    return c.agg(F.count("*").alias("total"), *cols)


def missing_fields(c: DataFrame, names: list[str]) -> DataFrame:
    return c.agg(*[F.count_if(F.coalesce(F.col(n).cast("string"), F.lit("")) == "").alias(f"missing_{n}") for n in names])


def insight_counts(c: DataFrame) -> DataFrame:
    """Eight conditional counts in one pass."""
    is_ = lambda column, value, name: F.count_if(F.col(column) == value).alias(name)
    return c.agg(
        F.count("*").alias("total"), *priority_counts()[:2], is_("severity", "high", "high"), is_("source_type", "import_alert", "import_alerts"), is_("source_type", "warning_letter", "warning_letters"),
        is_("signal_direction", "escalating", "escalating"), is_("classification_status", "confirmed", "confirmed"),
    )
