"""Classification, severity, priority, recurrence and clustering of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases as S
from ..functions import rules as R
from ..functions.expr import any_of, first_filled, first_match, icase, joined_filled, mdy_sort_key, rank_of

EVIDENCE = tuple(R.EVIDENCE.items())
# single words of the chemical mode count by an expression with word borders instead
COUNTED_MODE = [(mode, [p for p in phrases if " " in p or mode != "contamination_chemical"]) for mode, phrases in R.FAILURE_MODE]


def re(c: Column, pattern: str) -> Column:
    return c.rlike(icase(pattern))


def with_texts(c: DataFrame) -> DataFrame:
    """Adds best_text, context_text and their lower-case forms once."""
    c = c.withColumn("raw_listing_summary", F.substring(first_filled("summary", "violation_details"), 1, 500))
    rich = F.col("enrichment_status").isin("success", "cached") & (F.length(F.coalesce("enriched_text", F.lit(""))) > 250)
    c = c.withColumn("best_text", F.when(rich, F.col("enriched_text")).otherwise(first_filled("raw_listing_summary", "violation_details", "summary")))
    c = c.withColumn("context_text", joined_filled("raw_listing_summary", "summary", "violation_details", "enriched_text"))
    c = c.withColumn("severity_text", F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("violation_details", F.lit("")), F.coalesce("enriched_text", F.lit(""))))
    c = c.withColumn("best_lower", F.lower("best_text"))
    return c.withColumn("best", S.search(F.col("best_lower"), S.all_of(R.CATEGORY, R.FAILURE_MODE, EVIDENCE), ranked=R.CATEGORY, counted=COUNTED_MODE))


def infer_severity(text: Column, source_type: Column) -> Column:
    high = re(text, R.HIGH) | re(text, R.CLASS_ONE)
    return F.when(high, "high").when(source_type.isin(*R.MEDIUM_TYPES), "medium").when(re(text, R.LOW), "low").otherwise("medium")


def infer_facility(text: Column) -> Column:
    return first_match(F.lower(text), R.FACILITY, "General Pharma")


def first_category(text: Column, fallback: str = R.NO_DETAIL) -> Column:
    return first_match(F.lower(text), R.CATEGORY, fallback)


def categories(c: DataFrame) -> DataFrame:
    """Adds primary_gmp_category and up to three secondary ones, by phrases found."""
    c = c.withColumn("primary_gmp_category", F.coalesce(F.get("best.ranked", 0), F.lit(R.NO_DETAIL)))
    return c.withColumn("secondary_gmp_categories", F.slice("best.ranked", 2, 3))


def tobacco_only(text: Column) -> Column:
    return re(text, R.TOBACCO) & ~re(text, R.PHARMA_SAFETY)


def failure_mode(c: DataFrame) -> DataFrame:
    """Adds failure_mode and failure_mode_confidence (unrounded)."""
    scores = []
    for i, (mode, phrases) in enumerate(R.FAILURE_MODE):
        n = F.get("best.counts", i)
        if mode == "contamination_chemical":
            n = n + F.when(re(F.col("best_text"), R.CHEMICAL), 1).otherwise(0)
        scores.append(F.struct(F.least(F.lit(1.0), n / F.lit(max(len(phrases) * 0.3, 1.0))).alias("score"), F.lit(-i).alias("ord"), F.lit(mode).alias("mode")))
    best = F.array_max(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).alias("ord"), F.lit("").alias("mode")), *scores))
    guarded = F.struct(F.lit(0.1).alias("score"), F.lit(0).alias("ord"), F.lit("insufficient_detail").alias("mode"))
    c = c.withColumn("_mode", F.when(tobacco_only(F.col("context_text")), guarded).otherwise(best))
    return c.withColumns({"failure_mode": F.col("_mode.mode"), "failure_mode_confidence": F.col("_mode.score")}).drop("_mode")


def is_guidance(url: Column, title: Column) -> Column:
    return re(F.coalesce(url, F.lit("")), R.GUIDANCE_URL) | re(title, R.GUIDANCE_TITLE)


def is_enforcement(title: Column) -> Column:
    return re(title, R.ENFORCEMENT_SIGNAL)


def title_text() -> Column:
    return F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("violation_details", F.lit("")))


def evidence(c: DataFrame) -> DataFrame:
    """Adds category_evidence, category_confidence (unrounded), failure_mode_evidence,
    classification_basis and classification_status."""
    rich = F.col("enrichment_status").isin("success", "cached") & (F.length(F.coalesce("enriched_text", F.lit(""))) > 100)
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    basis = F.when(rich, "enriched_text").when(filled("raw_listing_summary"), "raw_listing_summary").when(filled("violation_details"), "violation_details").when(filled("summary"), "summary").otherwise("unknown")
    # the label's own terms, looked up in constant maps: one reference to a label, however many there are
    lists = lambda rules: F.create_map(*[x for label, p in rules for x in (F.lit(label), S.literal(p))])
    terms, modes = F.element_at(lists(EVIDENCE), F.col("primary_gmp_category")), F.element_at(lists(R.FAILURE_MODE), F.col("failure_mode"))
    exempt = F.col("primary_gmp_category").isin("Labelling & claims", "Ingredient safety", "Contamination & sterility")
    open_ = ~(is_guidance(F.col("url"), title_text()) & ~is_enforcement(title_text())) | exempt
    c = c.withColumns({"_terms": F.when(open_, terms), "_modes": modes, "_listing": F.lower(joined_filled("raw_listing_summary", "violation_details", "summary")), "_rich": F.when(rich, F.lower("enriched_text")).otherwise("")})
    within = lambda arr, hits: F.coalesce(F.array_intersect(arr, hits), F.array().cast("array<string>"))
    search = lambda t: S.found(F.col(t), S.all_of(EVIDENCE))
    c = c.withColumns({"_all": within("_terms", "best.found"), "_list": within("_terms", search("_listing")), "_enr": within("_terms", search("_rich"))})
    conf = F.when(F.col("_terms").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.size("_all") / F.greatest(F.size("_terms") * 0.25, F.lit(1.0))))
    status = F.when(F.col("_terms").isNull(), "unconfirmed").when(F.size("_enr") > 0, "confirmed").when((F.size("_list") > 0) & (conf >= 0.3), "provisional").when(F.size("_all") > 0, "provisional").otherwise("unconfirmed")
    out = c.withColumns({
        "category_evidence": F.slice("_all", 1, 10),
        "category_confidence": conf,
        "failure_mode_evidence": F.when(F.col("_terms").isNull(), F.array().cast("array<string>")).otherwise(F.slice(within("_modes", "best.found"), 1, 8)),
        "classification_basis": basis,
        "classification_status": status,
    })
    return out.drop("_terms", "_modes", "_listing", "_rich", "_all", "_list", "_enr", "best")


def priority(c: DataFrame) -> DataFrame:
    """Adds the severity dimensions, low_detail and priority."""
    t, low = F.col("severity_text"), F.lower("severity_text")
    one, two = low.contains("class i") & ~low.contains("class ii"), low.contains("class ii")
    critical = re(t, R.CRITICAL) | re(t, R.CLASS_ONE)
    kind = F.col("source_type")
    reg = (
        F.when(kind == "warning_letter", F.when(critical, "critical").otherwise("high"))
        .when(kind.isin(*R.ENFORCEMENT), F.when(one, "critical").when(two, "high").otherwise("medium"))
        .when(kind == "import_alert", F.when(low.contains("automatic detention"), "high").otherwise("medium"))
        .when(kind == "recall", F.when(critical | one, "critical").when(two, "high").otherwise("medium"))
        .when(kind == "safety_alert", F.when(any_of(low, ["urgent", "immediate", "serious"]), "high").otherwise("medium"))
        .otherwise(F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium")))
    )
    c = c.withColumn("regulatory_severity", reg)
    up = F.when(F.col("regulatory_severity") == "low", "medium").when(F.col("regulatory_severity") == "medium", "high").otherwise("critical")
    op = F.when(re(F.concat_ws(" ", "company", "facility_type"), R.CONTRACT), up).otherwise(F.col("regulatory_severity"))
    risk = F.when(kind == "warning_letter", "immediate").when(kind.isin("import_alert", "inspection_finding", "compliance_action"), "elevated").otherwise("standard")
    who = F.col("authority")
    market = F.when(who.isin("TGA", "MHRA", "BfR"), "direct").when(who == "EFSA", "reference").when(F.col("facility_type") == "Supplement / Nutraceutical", "indirect").otherwise("reference")
    detail = F.col("primary_gmp_category").isin(R.NO_DETAIL, "") & F.col("failure_mode").isin("insufficient_detail", "")
    c = c.withColumns({"operational_severity": op, "inspection_risk": risk, "market_relevance_au": market, "low_detail": detail})
    legal = (F.col("failure_mode") == "recall_mandatory") & (kind == "warning_letter") & ~re(t, R.PHARMA_SAFETY)
    grave = F.col("failure_mode").isin(*R.HIGH_RISK_MODES) & (F.col("failure_mode_confidence") >= 0.7) & ~legal
    r, d = F.col("regulatory_severity"), F.col("low_detail")
    p = (
        F.when(grave | ((r == "critical") & kind.isin("recall", *R.ENFORCEMENT)), "P1")
        .when(F.col("operational_severity").isin("high", "critical") & F.col("market_relevance_au").isin("direct", "indirect") & ~d, "P1")
        .when(r == "critical", "P2")
        .when((r == "high") & ~d, "P2")
        .when(((r == "high") | (F.col("inspection_risk") == "immediate")) & d, "P3")
        .when((r == "medium") & ~d, "P3")
        .otherwise("P4")
    )
    return c.withColumn("priority", p)


def fix_source_types(c: DataFrame) -> DataFrame:
    """Inspection findings that are guidance or opinions get their true type."""
    url = F.coalesce("url", F.lit(""))
    new = (
        F.when(F.col("authority").isin("EFSA", "BfR"), "scientific_opinion")
        .when((F.col("authority") == "MHRA") & url.contains("/guidance/"), "guidance")
        .when(is_guidance(url, title_text()) & ~is_enforcement(title_text()), "guidance")
    )
    return c.withColumn("source_type", F.when(F.col("source_type") == "inspection_finding", F.coalesce(new, "source_type")).otherwise(F.col("source_type")))


def recurrence(c: DataFrame, as_of: str) -> DataFrame:
    """Adds 90-day recurrence counts, direction and pressure, and raises repeat offenders to P1.

    Categories and modes are fixed tables, so their counts are sent to the rows; only companies are
    joined by shuffle, where a row without one has a key of its own: its counts are zero by definition."""
    day = lambda n: F.date_sub(F.lit(as_of).cast("date"), n)
    inside = F.col("date") >= day(90)
    company = F.nullif(F.lower(F.trim("company")), F.lit(""))
    counts = lambda key: c.where(inside).groupBy(key.alias("_k")).agg(F.count("*").alias("_n"), F.count_if(F.col("date") >= day(45)).alias("_now")).where("_k is not null")
    out = c.withColumn("_co", company)
    for name, key in (("primary_gmp_category", F.col("primary_gmp_category")), ("failure_mode", F.nullif("failure_mode", F.lit("")))):
        side = F.broadcast(counts(key).toDF("_k", f"_n{name}", f"_now{name}"))  # as many rows as the fixed table has labels
        out = out.join(side, out[name] == side["_k"], "left").drop("_k")
    out = out.withColumn("_co_key", F.coalesce("_co", F.concat(F.lit("\0"), "id")))
    side = counts(company).toDF("_k", "_n_co", "_now_co")
    # hashed: wide rows of a frequent company stream by and are not sorted
    out = out.join(side.hint("shuffle_hash"), out["_co_key"] == side["_k"], "left").drop("_k")
    less = lambda n: F.greatest(F.coalesce(n, F.lit(0)) - 1, F.lit(0)).cast("long")
    now, n = F.coalesce("_nowprimary_gmp_category", F.lit(0)), F.coalesce("_nprimary_gmp_category", F.lit(0))
    prior = n - now
    out = out.withColumns({
        "recurrence_count_company_90d": less(F.col("_n_co")),
        "recurrence_count_category_90d": less(F.col("_nprimary_gmp_category")),
        "recurrence_count_failure_mode_90d": less(F.col("_nfailure_mode")),
        "signal_direction": F.when(F.coalesce("_n_co", F.lit(0)) >= 2, "escalating").when(F.col("_co").isNotNull() & (F.col("date") < day(60)), "resolving").otherwise("holding"),
        "regulatory_pressure": F.when(prior == 0, "stable").when(now * 10 > 13 * prior, "increasing").when(now * 10 < 7 * prior, "decreasing").otherwise("stable"),
    })
    up = (F.col("recurrence_count_company_90d") >= 2) & (F.col("regulatory_severity") == "high") & F.col("priority").isin("P2", "P3")
    out = out.withColumn("priority", F.when(up, "P1").otherwise(F.col("priority")))
    return out.drop(*[x for x in out.columns if x.startswith(("_n", "_co"))])


def low_detail_cap(c: DataFrame) -> DataFrame:
    """P1 and P2 without detail, accepted prose or a safety term fall to P3."""
    thin = (F.col("failure_mode") == "insufficient_detail") & (F.col("failure_mode_confidence") <= 0.1)
    prose = (F.col("classification_confidence") >= 0.5) & (F.coalesce("decision_summary", F.lit("")) != "")
    spared = re(F.col("context_text"), R.LOW_DETAIL_SAFETY) | (F.col("source_type").isin("recall", *R.ENFORCEMENT) & F.col("operational_severity").isin("high", "critical")) | ((F.col("market_relevance_au") == "direct") & (F.col("regulatory_severity") == "high"))
    cap = F.col("priority").isin("P1", "P2") & thin & ~prose & ~spared
    return c.withColumn("priority", F.when(cap, "P3").otherwise(F.col("priority")))


def trust_cap(c: DataFrame) -> DataFrame:
    """P1 and P2 fall to P4 for what is no enforcement, to P3 for unconfirmed weak sources."""
    safe = re(F.col("context_text"), R.LOW_DETAIL_SAFETY)
    top = F.col("priority").isin("P1", "P2")
    soft = F.col("source_type").isin(*R.NOT_ENFORCEMENT)
    p = F.when(top & soft, F.when(safe, F.col("priority")).otherwise("P4")).when(top & (F.col("classification_status") == "unconfirmed") & ~F.col("source_type").isin(*R.STRONG) & ~safe, "P3").otherwise(F.col("priority"))
    return c.withColumn("priority", p)


def date_bucket(c: DataFrame) -> Column:
    """Cluster bucket: an import alert is alone, warning letters by half month, others by month."""
    ym = F.date_format("date", "yyyy-MM")
    half = F.when(F.dayofmonth("date") <= 14, "E").otherwise("L")
    return F.when(F.col("source_type") == "import_alert", F.col("id")).when(F.col("date").isNull(), F.col("id")).when(F.col("source_type") == "warning_letter", F.concat(ym, F.lit("-"), half)).otherwise(ym)


def entity_label(c: DataFrame) -> Column:
    return F.coalesce(F.nullif("company", F.lit("")), F.nullif("product_type", F.lit("")), F.concat(F.lit("Unknown entity — "), "authority", F.lit(" "), "source_type"))


def clusters(c: DataFrame) -> DataFrame:
    """Adds cluster_id, size, primary, priority, reason and label; singletons keep null ids.

    Group figures are partial aggregates joined back, and the primary is one maximum a
    group, so that a large group is never sorted in one task."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    c = c.withColumn("_entity", entity_label(c))
    c = c.withColumn("_key", F.concat_ws("|", F.trim(F.lower("_entity")), low("authority"), low("source_type"), low("failure_mode"), date_bucket(c)))
    prio = rank_of(F.coalesce("priority", F.lit("")), ["P1", "P2", "P3", "P4"], 4)
    prose = F.when((F.col("classification_confidence") >= 0.5) & (F.coalesce("decision_summary", F.lit("")) != ""), 0).otherwise(1)
    c = c.withColumns({"_rank": F.struct(prio.alias("p"), prose.alias("a"), (-mdy_sort_key(F.col("date"))).alias("d"), "id"), "_ym": F.date_format("date", "yyyy-MM")})
    g = c.groupBy("_key").agg(F.count("*").alias("cluster_size"), F.min("_rank").alias("_first"), F.min_by(F.struct("_entity", "failure_mode"), "_rank").alias("_lead"), F.count("date").alias("_dated"), F.min("_ym").alias("_from"), F.max("_ym").alias("_to"))
    out = c.join(g.hint("shuffle_hash"), "_key")
    many = F.col("cluster_size") > 1
    mode = F.regexp_replace(F.coalesce("_lead.failure_mode", F.lit("")), "_", " ")
    label = F.when(~mode.isin("insufficient detail", ""), F.concat(F.col("_lead._entity"), F.lit(" — "), mode)).otherwise(F.col("_lead._entity"))
    size = F.col("cluster_size").cast("string")
    span = F.when(F.col("_dated") >= 2, F.concat(size, F.lit(" records, "), "_from", F.lit("–"), "_to")).when(F.col("_dated") == 1, F.concat(size, F.lit(" records, "), "_from")).otherwise(F.concat(size, F.lit(" records")))
    out = out.withColumns({
        "cluster_id": F.when(many, F.substring(F.sha2("_key", 256), 1, 12)),
        "cluster_primary": ~many | (F.col("_rank") == F.col("_first")),
        "cluster_label": F.when(many, F.substring(label, 1, 120)),
        "cluster_reason": F.when(many, span),
        "cluster_priority": F.when(many, F.element_at(F.array(*map(F.lit, ["P1", "P2", "P3", "P4", ""])), F.col("_first.p") + 1)),
    })
    return out.drop("_key", "_entity", "_rank", "_ym", "_first", "_lead", "_dated", "_from", "_to")


def classified(c: DataFrame) -> DataFrame:
    return evidence(failure_mode(categories(with_texts(c))))


def full(c: DataFrame, as_of: str) -> DataFrame:
    """The whole chain in its order: types, classes, priority, recurrence, caps, clusters."""
    return clusters(trust_cap(low_detail_cap(fix_source_types(recurrence(priority(classified(fix_source_types(c))), as_of)))))


def top_priorities(c: DataFrame, k: int = 20) -> DataFrame:
    """Groups by entity, authority, type and mode with two P1/P2 records or more."""
    rows = c.where(F.col("priority").isin("P1", "P2")).withColumn("entity", F.lower(F.trim(entity_label(c))))
    g = rows.groupBy("entity", "authority", "source_type", "failure_mode").agg(F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("priority") == "P2").alias("p2"), F.count("*").alias("total"))
    return g.where("total >= 2").orderBy(F.desc("total"), F.desc("p1"), "entity", "authority", "source_type", "failure_mode").limit(k)


def cluster_stats(c: DataFrame) -> DataFrame:
    """One row per multi-record cluster: size, priorities, date range."""
    return c.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("priority") == "P2").alias("p2"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def window_newest(c: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The newest ``k`` rows of each group, undated last."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("date"), "id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
