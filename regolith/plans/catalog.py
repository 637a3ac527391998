"""Registered queries over the derived views, each with its DuckDB statement.

A name starts with the identifier of the operator that it exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..operators import alerts as A
from ..operators import citations as C
from ..operators import enrich as E
from ..operators import facets as T
from ..operators import report90 as N
from ..operators import rollups as U
from ..operators import store as S
from ..operators import trends as G
from ..sources import parsers as P
from . import oracle as O
from .views import CITATIONS_AS_OF, SIGNALS_AS_OF, citations, signals, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def on_signals(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(signals(spark, d))
        if sql:
            SQL[name] = sql
        return f

    return add


_written: dict[tuple[str, str, str], str] = {}


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """Citations in even parts: a file is read by its row groups, and classification is far more work than reading."""
    return citations(spark, d).repartition("rec_no")


def _stored(spark: SparkSession, d: str, stage: str) -> DataFrame:
    """A stage of the citation store, written once per application and input.

    Queries read the written table, so their filters meet plain columns and push into the scan
    instead of unfolding the chain's expressions."""
    key = (spark.sparkContext.applicationId, d, stage)
    if key not in _written:
        if stage == "priority":
            rows = C.priority(C.classified(C.fix_source_types(_dealt(spark, d)))).drop("severity_text", "best_lower")  # derived, used by no later step
        else:
            capped = C.trust_cap(C.low_detail_cap(C.fix_source_types(C.recurrence(_stored(spark, d, "priority"), CITATIONS_AS_OF))))
            rows = C.clusters(capped.drop("context_text"))
        _written[key] = S.write_shared(rows, f"citations-{stage}")
    return spark.read.parquet(_written[key])


def on_citations(name: str, sql: str | None = None, stage: str = "raw"):
    """``stage`` is how far the chain runs before the query: raw, classified, severity, or the stored
    priority and full tables."""
    steps = {
        "raw": citations,
        "classified": lambda spark, d: C.classified(C.fix_source_types(_dealt(spark, d))),
        "severity": lambda spark, d: C.priority(C.classified(C.fix_source_types(_dealt(spark, d)))),
        "priority": lambda spark, d: _stored(spark, d, "priority"),
        "full": lambda spark, d: _stored(spark, d, "full"),
    }

    def add(f):
        QUERIES[name] = lambda spark, d: f(steps[stage](spark, d))
        if sql:
            SQL[name] = sql
        return f

    return add


B = "::bigint"
RULES = [
    A.Rule("mentions", "ingredient_mention", ingredients=("almond", "blue"), sources=("tga", "fda")),
    A.Rule("severe", "severity_threshold", min_severity="high", extra_field="market_significance", extra_value="HIGH"),
    A.Rule("sources", "new_source_signal", sources=("pubmed", "artg"), min_severity="medium"),
    A.Rule("spiking", "trend_spike", min_spike_ratio=2.5),
    A.Rule("worse", "sentiment_shift", min_shift=0.3),
    A.Rule("claims", "claim_shift", to_type="safety_concern"),
    A.Rule("odd", "no_such_trigger"),
]
AUTH = ["FDA", "TGA", "EFSA", "MHRA"]
NOISELESS = f"""not regexp_matches(lower(coalesce(summary, '')), '{"|".join(R.NOISE)}') and source_type in {O.in_list(R.ENFORCEMENT_TYPES)} and lower(trim(summary)) not in {O.in_list(R.JUNK_EXACT)}
 and not regexp_matches(lower(trim(summary)), '^({"|".join(R.JUNK_START)})') and (len(string_split_regex(trim(summary), '\\s+')) >= 5 or regexp_matches(lower(summary), '{"|".join(R.ACTION_VERBS)}'))"""
ISSUE = f"""case when failure_mode not in ('', 'insufficient_detail') and failure_mode_confidence >= 0.6 then replace(failure_mode, '_', ' ') when primary_gmp_category not in {O.in_list(R.BROAD)} then primary_gmp_category
 else coalesce(list_filter(secondary_gmp_categories, lambda x: x not in {O.in_list(R.BROAD)})[1], 'Unclassified') end"""
PROV = f"(not (failure_mode not in ('', 'insufficient_detail') and failure_mode_confidence >= 0.6) and primary_gmp_category not in {O.in_list(R.BROAD)} and classification_status = 'provisional')"
P123 = "count(*) filter (priority = 'P1') as p1, count(*) filter (priority = 'P2') as p2"

# ---- signals: trends, sentiment, shifts -------------------------------------------------


@on_signals("flt01_recent", f"{O.SIG} select source_id, authority, severity from s where {O.S30}")
def _(s):
    return G.recent(s, SIGNALS_AS_OF).select("source_id", "authority", "severity")


on_signals("flt02_missing_sentiment", f"{O.SIG} select source_id from s where coalesce(sentiment, '') = ''")(lambda s: S.missing(s, "sentiment").select("source_id"))
on_signals("flt03_missing_summary", f"{O.SIG} select source_id from s where coalesce(ai_summary, '') = ''")(lambda s: S.missing(s, "ai_summary").select("source_id"))
on_signals("agg01_rolling_counts", f"{O.ROLLING} select * from rolling")(lambda s: G.rolling_counts(s, SIGNALS_AS_OF))
on_signals("agg02_spikes", f"{O.SPIKES} select ingredient, count_7d, count_30d from spikes")(lambda s: G.spikes(s, SIGNALS_AS_OF).select("ingredient", "count_7d", "count_30d"))
on_signals(
    "agg03_weighted_sentiment",
    f"{O.SENTIMENT} select ingredient, n, floor(score_30d * 1e6 + 0.5)::bigint as score_30d, floor(score_14d * 1e6 + 0.5)::bigint as score_14d, floor(score_prior * 1e6 + 0.5)::bigint as score_prior, shift < -0.3 as rising_risk from sentiments",
)(lambda s: G.sentiment(s, SIGNALS_AS_OF).select("ingredient", "n", *[F.floor(F.col(c) * 1e6 + 0.5).alias(c) for c in ("score_30d", "score_14d", "score_prior")], "rising_risk"))
on_signals("agg04_sentiment_distribution", f"{O.SIG} select sentiment, count(*) as n from s where coalesce(sentiment, '') <> '' and {O.S30} group by 1")(lambda s: G.sentiment_distribution(s, SIGNALS_AS_OF))
on_signals("win01_claim_shift", f"{O.SHIFT} select * from shifts")(lambda s: G.claim_shift(s, SIGNALS_AS_OF))
_WOW = "count(*) filter ({7}) as curr, count(*) filter (not ({7})) as prev".replace("{7}", O.S7)
on_signals(
    "agg18_week_over_week",
    f"{O.SIG}, w as (select ing as key, {_WOW} from s where ing is not null and {O.S14} and length(ing) >= 3 and regexp_matches(ing, '[a-z]') and ing not in {O.in_list(R.INVALID_INGREDIENT)} group by 1) select *, curr - prev as change from w where curr > 0 order by curr - prev desc, curr desc, key limit 6",
)(lambda s: G.week_over_week(s, F.when(T.clean_ingredient(F.col("ingredient_name")), X.norm_key("ingredient_name")), SIGNALS_AS_OF))
on_signals("agg21_enforcement_movement", f"{O.SIG}, w as (select authority as key, {_WOW} from s where authority in ('tga', 'fda', 'artg', 'adverse_events', 'tga_consultations', 'efsa', 'cochrane') and {O.S14} group by 1) select *, curr - prev as change from w where curr > 0")(
    lambda s: G.week_over_week(s.where(F.col("authority").isin("tga", "fda", "artg", "adverse_events", "tga_consultations", "efsa", "cochrane")), F.col("authority"), SIGNALS_AS_OF)
)
on_signals(
    "agg24_trend_class",
    f"{O.SIG}, w as (select ing as key, {_WOW} from s where ing is not null and {O.S14} group by 1) select *, curr - prev as change, case when (curr - prev) * 10 > 3 * curr then 'rising' when (prev - curr) * 10 > 3 * curr then 'declining' else 'stable' end as trend from w where curr > 0",
)(lambda s: G.trend_class(G.week_over_week(s, X.norm_key("ingredient_name"), SIGNALS_AS_OF, None)))
on_signals("flt06_clean_ingredients", f"{O.SIG} select distinct lower(trim(ingredient_name)) as ingredient from s where length(trim(ingredient_name)) >= 3 and regexp_matches(lower(ingredient_name), '[a-z]') and lower(trim(ingredient_name)) not in {O.in_list(R.INVALID_INGREDIENT)}")(
    lambda s: s.where(T.clean_ingredient(F.col("ingredient_name"))).select(F.lower(F.trim("ingredient_name")).alias("ingredient")).distinct()
)
on_signals("flt18_urgent", f"{O.SIG} select source_id from s where severity = 'high' or market_significance = 'high'")(lambda s: s.where("severity = 'high' or market_significance = 'high'").select("source_id"))
on_signals("agg06_severity_counts", f"{O.SIG} select count(*) filter (severity = 'high') as high, count(*) filter (severity = 'medium') as medium, count(*) filter (severity = 'low') as low from s")(
    lambda s: s.agg(*[F.count_if(F.col("severity") == x).alias(x) for x in ("high", "medium", "low")])
)
on_signals("agg22_authority_sentiment", f"{O.SIG} select authority, count(*) filter (sentiment = 'positive') as positive, count(*) filter (sentiment = 'neutral') as neutral, count(*) filter (sentiment = 'negative') as negative from s group by 1")(
    lambda s: s.groupBy("authority").agg(*[F.count_if(F.col("sentiment") == x).alias(x) for x in ("positive", "neutral", "negative")])
)
on_signals(
    "agg25_entity_rollup",
    f"{O.SIG} select min_by(ingredient_name, rec_no) as name, count(*) as total, count(*) filter (severity = 'high') as high, count(*) filter (sentiment = 'negative') as negative, count(*) filter (sentiment = 'positive') as positive from s where coalesce(ingredient_name, '') <> '' group by lower(ingredient_name)",
)(
    lambda s: s.where("coalesce(ingredient_name, '') <> ''")
    .groupBy(F.lower("ingredient_name").alias("k"))
    .agg(F.min_by("ingredient_name", "rec_no").alias("name"), F.count("*").alias("total"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("sentiment") == "negative").alias("negative"), F.count_if(F.col("sentiment") == "positive").alias("positive"))
    .drop("k")
)
on_signals(
    "agg28_changed_since_latest",
    f"{O.SIG}, m as (select max(scraped_at) as mx from s) select authority, count(*) filter (scraped_at >= mx - interval 7 day) as curr, count(*) filter (scraped_at < mx - interval 7 day and scraped_at >= mx - interval 14 day) as prev from s, m group by 1",
)(
    lambda s: s.join(F.broadcast(s.agg(F.max("scraped_at").alias("mx"))))
    .groupBy("authority")
    .agg(F.count_if(F.expr("scraped_at >= mx - interval 7 days")).alias("curr"), F.count_if(F.expr("scraped_at < mx - interval 7 days and scraped_at >= mx - interval 14 days")).alias("prev"))
)
on_signals("srt03_severity_order", f"{O.SIG} select source_id, case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end as rank from s order by rank, scraped_at desc, rec_no limit 50")(
    lambda s: s.select("source_id", X.rank_of(F.col("severity"), ["high", "medium", "low"], 3).alias("rank"), "scraped_at", "rec_no").orderBy("rank", F.desc("scraped_at"), "rec_no").limit(50).select("source_id", "rank")
)
on_signals("srt08_page", f"{O.SIG} select source_id from s order by scraped_at desc, rec_no limit 20 offset 40")(lambda s: s.orderBy(F.desc("scraped_at"), "rec_no").offset(40).limit(20).select("source_id"))
on_signals(
    "set06_overview_feed",
    f"{O.SIG} select source_id, tier from (select *, case when severity = 'high' then 0 else 1 end as tier from s where severity = 'high' or (severity = 'medium' and authority in ('tga', 'fda'))) order by tier, scraped_at desc, rec_no limit 12",
)(
    lambda s: s.where("severity = 'high' or (severity = 'medium' and authority in ('tga', 'fda'))")
    .withColumn("tier", F.when(F.col("severity") == "high", 0).otherwise(1))
    .orderBy("tier", F.desc("scraped_at"), "rec_no")
    .limit(12)
    .select("source_id", "tier")
)
on_signals("prj01_stable_ids", f"{O.SIG} select rec_no, substr(sha256(authority || '::' || url), 1, 16) as source_id, substr(md5(authority || '::' || url), 1, 12) as citation_id from s")(
    lambda s: s.select("rec_no", X.short_hash(F.col("authority"), F.col("url")).alias("source_id"), X.short_hash(F.col("authority"), F.col("url"), bits=128, length=12).alias("citation_id"))
)
on_signals("win05_keep_first_url", f"{O.SIG} select url, min(rec_no) as rec_no from s group by 1")(lambda s: T.keep_first(s, F.col("url"), F.col("rec_no")).select("url", "rec_no"))
on_signals("win09_first_seen", f"{O.SIG} select ing as ingredient, min(rec_no) as first from s where ing is not null group by 1 order by 2 limit 5")(
    lambda s: s.select(X.norm_key("ingredient_name").alias("ingredient"), "rec_no").where("ingredient is not null").groupBy("ingredient").agg(F.min("rec_no").alias("first")).orderBy("first").limit(5)
)


def _halves(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = s.select("rec_no", "url", "authority", "sentiment", "severity")
    return rows.where("rec_no % 3 = 0 and rec_no % 601 < 300").withColumn("source_id", F.col("url")).transform(lambda d: T.keep_first(d, F.col("source_id"), F.col("rec_no"))), rows.withColumn("source_id", F.col("url"))


_HALF = f"{O.SIG}, old as (select * from s where rec_no % 3 = 0 and rec_no % 601 < 300 qualify row_number() over (partition by url order by rec_no) = 1)"
on_signals("snk01_insert_or_ignore", f"{_HALF} select rec_no, url from old union all (select rec_no, url from s where url not in (select url from old) qualify row_number() over (partition by url order by rec_no) = 1)")(lambda s: S.insert_or_ignore(*_halves(s)).select("rec_no", "url"))
on_signals("snk02_insert_count", f"{_HALF} select count(distinct url) as inserted from s where url not in (select url from old)")(lambda s: S.insert_new(*_halves(s)).agg(F.count("*").alias("inserted")))
on_signals("snk03_update_sentiment", f"{_HALF}, ch as (select url, 'neutral' as sentiment from old where rec_no % 2 = 0) select o.url, coalesce(ch.sentiment, o.sentiment) as sentiment from old o left join ch using (url)")(
    lambda s: S.update(_halves(s)[0], _halves(s)[0].where("rec_no % 2 = 0").select("source_id", F.lit("neutral").alias("sentiment"))).select("url", "sentiment")
)
on_signals("jon02_anti_join", f"{_HALF} select rec_no from s where url not in (select url from old)")(lambda s: S.unseen(_halves(s)[1], _halves(s)[0], "source_id").select("rec_no"))
on_signals("agg43_run_summary", f"{O.SIG} select authority, count(*) as rows, count(distinct url) as urls from s group by 1")(lambda s: s.groupBy("authority").agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls")))


def _alerts(s: DataFrame) -> DataFrame:
    fired = A.evaluate(RULES, G.recent(s, SIGNALS_AS_OF), G.spikes(s, SIGNALS_AS_OF), G.sentiment(s, SIGNALS_AS_OF), G.claim_shift(s, SIGNALS_AS_OF))
    return fired.select("rule_name", "trigger_type", "matches", F.array_join("items", ",").alias("items"))


def _fired(name: str, trigger: str, item: str, source: str, cut: bool) -> str:
    items = "list_sort(list(distinct nullif(i, '')))"
    shown = f"{items}[1:5]" if cut else items
    return f"select '{name}' as rule_name, '{trigger}' as trigger_type, count(*) as matches, array_to_string({shown}, ',') as items from (select {item} as i from {source}) having count(*) > 0"


_ING = "lower(trim(ingredient_name))"
SQL["rul01_06_alerts"] = (
    O.SHIFT
    + O.SPIKES.removeprefix(O.SIG)
    + O.SENTIMENT.removeprefix(O.SIG)
    + " "
    + " union all ".join([
        _fired("mentions", "ingredient_mention", _ING, f"s where {O.S30} and (contains({_ING}, 'almond') or contains({_ING}, 'blue')) and authority in ('tga', 'fda')", True),
        _fired("severe", "severity_threshold", _ING, f"s where {O.S30} and severity = 'high' and market_significance = 'high'", False),
        _fired("sources", "new_source_signal", "authority", f"s where {O.S30} and authority in ('pubmed', 'artg') and severity in ('high', 'medium')", False),
        _fired("spiking", "trend_spike", "ingredient", "spikes where spike_ratio >= 2.5", True),
        _fired("worse", "sentiment_shift", "ingredient", "sentiments where shift < -0.3 and abs(shift) >= 0.3", True),
        _fired("claims", "claim_shift", "ingredient", "shifts where to_type = 'safety_concern'", True),
    ])
)
QUERIES["rul01_06_alerts"] = lambda spark, d: _alerts(signals(spark, d))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d, "labels", "documents")
    rows = t["labels"].join(t["documents"].select("doc_id", "source"), "doc_id")
    rating = F.when(F.col("quality") == 0, "incorrect").when(F.col("toxic") == 1, "partially_correct").otherwise("correct")
    note = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("note "), F.col("doc_id").cast("string")))
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), rating.alias("rating"), note.alias("correction_note"), (F.col("doc_id") % 97).alias("created_at"))


_FB = "with fb as (select l.doc_id as id, d.source as source_id, case when quality = 0 then 'incorrect' when toxic = 1 then 'partially_correct' else 'correct' end as rating, case when l.doc_id % 5 = 0 then '' else 'note ' || l.doc_id end as correction_note, l.doc_id % 97 as created_at from labels l join documents d using (doc_id))"
QUERIES["agg05_accuracy"] = lambda spark, d: S.accuracy(_feedback(spark, d))
SQL["agg05_accuracy"] = f"{_FB} select count(*) as total, count(*) filter (rating = 'correct') as correct, count(*) filter (rating = 'incorrect') as incorrect, count(*) filter (rating = 'partially_correct') as partially_correct from fb"
QUERIES["jon01_corrections"] = lambda spark, d: S.corrections(_feedback(spark, d), tables(spark, d, "documents")["documents"].groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("rows"))).select("id", "source_id", "rating", "rows")
SQL["jon01_corrections"] = f"{_FB} select id, source_id, rating, rows from (select * from fb where rating <> 'correct' and correction_note <> '' order by created_at desc, id desc limit 20) left join (select source as source_id, count(*) as rows from documents group by 1) using (source_id)"

# ---- citations: classification and priority ---------------------------------------------

on_citations("prj09_first_category", f"{O.CIT} select rec_no, coalesce((select label from catr where contains(lower(summary), phrase) order by ord limit 1), '{R.NO_DETAIL}') as category from raw")(lambda c: c.select("rec_no", C.first_category(F.col("summary")).alias("category")))
on_citations("prj06_facility", f"{O.CIT} select rec_no, coalesce((select label from facr where contains(lower(summary), phrase) order by ord limit 1), 'General Pharma') as facility from raw")(lambda c: c.select("rec_no", C.infer_facility(F.col("summary")).alias("facility")))
on_citations(
    "prj04_severity",
    f"{O.CIT} select rec_no, case when {O.rx('summary', R.HIGH)} or {O.class_one('summary')} then 'high' when source_type in {O.in_list(R.MEDIUM_TYPES)} then 'medium' when {O.rx('summary', R.LOW)} then 'low' else 'medium' end as inferred from raw",
)(lambda c: c.select("rec_no", C.infer_severity(F.col("summary"), F.col("source_type")).alias("inferred")))
on_citations("prj10_multi_label", f"{O.CATS} select rec_no, primary_gmp_category, array_to_string(secondary_gmp_categories, '|') as secondary from cats", "classified")(lambda c: c.select("rec_no", "primary_gmp_category", F.array_join("secondary_gmp_categories", "|").alias("secondary")))
on_citations("prj11_failure_mode", f"{O.MODES} select rec_no, failure_mode, floor(failure_mode_confidence * 1e6 + 0.5)::bigint as confidence from modes", "classified")(lambda c: c.select("rec_no", "failure_mode", F.floor(F.col("failure_mode_confidence") * 1e6 + 0.5).alias("confidence")))
on_citations("prj12_tobacco_guard", f"{O.CIT} select rec_no from raw where {O.rx('summary', R.TOBACCO)} and not {O.rx('summary', R.PHARMA_SAFETY)}")(lambda c: c.where(C.tobacco_only(F.col("summary"))).select("rec_no"))
on_citations(
    "prj13_evidence",
    f"{O.EVIDENCE} select rec_no, classification_status, classification_basis, n_evidence::int as n_evidence, floor(category_confidence * 1e6 + 0.5)::bigint as confidence from evid",
    "classified",
)(lambda c: c.select("rec_no", "classification_status", "classification_basis", F.size("category_evidence").alias("n_evidence"), F.floor(F.col("category_confidence") * 1e6 + 0.5).alias("confidence")))
on_citations("prj14_best_text", f"{O.TEXTS} select rec_no, md5(best_text) as best, md5(context_text) as context from t", "classified")(lambda c: c.select("rec_no", F.md5("best_text").alias("best"), F.md5("context_text").alias("context")))
on_citations("prj16_entity_label", f"{O.CIT} select rec_no, {O._ENT} as entity from raw")(lambda c: c.select("rec_no", C.entity_label(c).alias("entity")))
on_citations("prj17_priority", f"{O.PRIO} select rec_no, regulatory_severity, operational_severity, inspection_risk, market_relevance_au, low_detail, priority from prio", "severity")(
    lambda c: c.select("rec_no", "regulatory_severity", "operational_severity", "inspection_risk", "market_relevance_au", "low_detail", "priority")
)
on_citations("prj18_source_types", f"{O.FIXED} select rec_no, source_type from fixed")(lambda c: C.fix_source_types(c).select("rec_no", "source_type"))
on_citations("agg11_recurrence", f"{O.RECUR} select rec_no, recurrence_count_company_90d, recurrence_count_category_90d, recurrence_count_failure_mode_90d, signal_direction, regulatory_pressure, priority from rec", "priority")(
    lambda c: C.recurrence(c, CITATIONS_AS_OF).select("rec_no", "recurrence_count_company_90d", "recurrence_count_category_90d", "recurrence_count_failure_mode_90d", "signal_direction", "regulatory_pressure", "priority")
)
on_citations("prj19_low_detail_cap", f"{O.CAPS} select rec_no, priority from cap1", "priority")(lambda c: C.low_detail_cap(C.recurrence(c, CITATIONS_AS_OF)).select("rec_no", "priority"))
on_citations("prj20_trust_cap", f"{O.CAPS} select rec_no, priority from cap2", "priority")(lambda c: C.trust_cap(C.low_detail_cap(C.recurrence(c, CITATIONS_AS_OF))).select("rec_no", "priority"))
on_citations("prj21_date_bucket", f"{O.CLUST} select rec_no, bucket from k0", "full")(lambda c: c.select("rec_no", C.date_bucket(c).alias("bucket")))
on_citations("prj22_date_key", f"{O.CIT} select rec_no, coalesce(strftime(date, '%Y%m%d')::int, 0) as k from raw")(lambda c: c.select("rec_no", X.mdy_sort_key(F.col("date")).alias("k")))
on_citations("win02_clusters", f"{O.CLUST} select rec_no, cluster_id, cluster_size, cluster_primary, cluster_priority, cluster_reason from clus", "full")(lambda c: c.select("rec_no", "cluster_id", "cluster_size", "cluster_primary", "cluster_priority", "cluster_reason"))
on_citations("agg09_cluster_labels", f"{O.CLUST} select rec_no, cluster_label from clus where cluster_size > 1", "full")(lambda c: c.where("cluster_size > 1").select("rec_no", "cluster_label"))
on_citations(
    "agg08_priority_groups",
    f"{O.CLUST} select lower(trim(entity)) as entity, authority, source_type, failure_mode, {P123}, count(*) as total from clus where priority in ('P1', 'P2') group by 1, 2, 3, 4 having count(*) >= 2 order by total desc, p1 desc, 1, 2, 3, 4 limit 20",
    "full",
)(C.top_priorities)
on_citations("agg10_cluster_stats", f"{O.CLUST} select cluster_id, count(*) as size, {P123}, min(date) as first_date, max(date) as last_date from clus where cluster_size > 1 group by 1", "full")(C.cluster_stats)
on_citations("agg07_counts", f"{O.CLUST} select priority, classification_status, count(*) as n from clus group by 1, 2", "full")(lambda c: U.counts(c, "priority", "classification_status"))
on_citations("srt10_top_modes", f"{O.CLUST} select failure_mode, count(*) as n from clus group by 1 order by n desc, min(rec_no) limit 8", "full")(lambda c: U.top_counts(c, "failure_mode", 8, "rec_no"))

# ---- facets, display, roll-ups ----------------------------------------------------------

on_citations("flt07_di_capa", f"{O.CIT} select rec_no from raw where regexp_matches(lower(coalesce(summary, '') || ' ' || coalesce(violation_details, '')), '{'|'.join(R.DI_CAPA)}')")(lambda c: c.where(T.is_di_capa(c)).select("rec_no"))
on_citations("flt08_low_value", f"{O.CIT} select rec_no from raw where regexp_matches(lower(summary), '{'|'.join(R.NOISE)}')")(lambda c: c.where(T.is_low_value(c)).select("rec_no"))
on_citations("flt09_valid_enforcement", f"{O.CIT} select rec_no from raw where {NOISELESS}")(lambda c: c.where(T.is_valid_enforcement(c) & ~T.is_low_value(c)).select("rec_no"))
FACETS = T.Facets(authority="FDA", category="Equipment & facilities", priority=("P2", "P3"), query="equipment", date_from="1996-01-01", date_to="2000-12-31")
on_citations(
    "flt10_facets",
    f"{O.CLUST} select rec_no, date, priority from clus where {NOISELESS} and authority = 'FDA' and primary_gmp_category = 'Equipment & facilities' and priority in ('P2', 'P3') and (date is null or date between date '1996-01-01' and date '2000-12-31') and contains(lower(concat_ws(' ', summary, primary_gmp_category, failure_mode, company, authority, source_type, facility_type, violation_details, decision_summary)), 'equipment')",
    "full",
)(lambda c: T.search(c, FACETS).select("rec_no", "date", "priority"))
on_citations("flt11_match_count", f"{O.CLUST} select count(*) filter ({NOISELESS} and authority = 'TGA' and priority = 'P1') as n from clus", "full")(lambda c: T.match_count(c, T.Facets(authority="TGA", priority="P1")))
on_citations("flt13_issue_match", f"{O.CLUST} select rec_no from clus where {ISSUE} = 'inadequate testing'", "full")(lambda c: c.where(T.base_issue(T.display_issue()) == "inadequate testing").select("rec_no"))
on_citations("prj31_family", f"""{O.CIT}, f as (select rec_no, case when {O.rx('summary', 'family smoking prevention|tobacco control act')} then 'tobacco_compliance' when {O.rx('summary', 'foreign supplier verification|fsvp')} then 'fsvp' when {O.rx('summary', 'import alert|detention without physical examination')} then 'import_alert_dwpe' end as family from raw) select * from f where family is not null""")(
    lambda c: c.select("rec_no", T.summary_family(F.col("summary")).alias("family")).where("family is not null")
)
on_citations(
    "prj32_display_key",
    f"{O.CIT} select rec_no, authority || '|' || source_type || '||' || lower(company) || '|' || case when {O.rx('summary', 'tobacco control act')} then 'tobacco_compliance' when contains(lower(summary), 'fsvp') then 'fsvp' when contains(lower(summary), 'import alert') then 'import_alert_dwpe' else substr(lower(trim(summary)), 1, 100) end as k from raw",
)(lambda c: c.select("rec_no", T.display_key(c).alias("k")))
on_citations("prj33_display_issue", f"{O.CLUST} select rec_no, case when {PROV} then 'Provisional: ' else '' end || {ISSUE} as issue from clus", "full")(lambda c: c.select("rec_no", T.display_issue().alias("issue")))
on_citations(
    "prj34_display_category",
    f"{O.CLUST} select rec_no, case when primary_gmp_category in ('', '{R.NO_DETAIL}') then primary_gmp_category when classification_status = 'unconfirmed' then 'Limited detail' when classification_status = 'provisional' then 'Provisional: ' || primary_gmp_category else primary_gmp_category end as category, case classification_status when 'confirmed' then 'Confirmed' when 'provisional' then 'Provisional' else 'Limited evidence' end as evidence from clus",
    "full",
)(lambda c: c.select("rec_no", T.display_category().alias("category"), T.evidence_status().alias("evidence")))
on_citations("prj35_url_quality", f"{O.CIT} select case when coalesce(url, '') = '' then 'missing' when contains(url, 'api.fda.gov') then 'api_endpoint' else 'direct_detail' end as quality, count(*) as n from raw group by 1")(lambda c: U.counts(c.withColumn("quality", T.url_quality(F.col("url"))), "quality"))
on_citations("prj36_recall_number", f"{O.CIT} select rec_no, nullif(regexp_extract(url, '[?&]RecallNumber=([^&#]+)', 1), '') as number from raw")(lambda c: c.select("rec_no", T.recall_number(F.col("url")).alias("number")))
on_citations(
    "agg36_display_groups",
    f"{O.CLUST} select authority, source_type, coalesce(strftime(date, '%Y-%m'), '') as month, lower(facility_type) as facility, lower(primary_gmp_category) as category, min(rec_no) as rec_no, count(*) as n from clus group by 1, 2, 3, 4, 5",
    "full",
)(T.display_groups)
on_citations("agg26_kpis", f"{O.CLUST} select count(*) as total, {P123}, count(*) filter (priority = 'P3') as p3, count(*) filter (severity = 'high') as high, count(*) filter (classification_status = 'confirmed') as confirmed, count(*) filter (cluster_primary) as primaries, count(distinct authority) as authorities from clus", "full")(U.kpis)
on_citations("agg27_changed", f"{O.CLUST}, w as (select authority, count(*) filter (date >= {O.day(60)}) as curr, count(*) filter (date < {O.day(60)}) as prior from clus where date >= {O.day(120)} group by 1) select *, curr - prior as delta from w where prior > 1 and abs(curr - prior) > 0", "full")(
    lambda c: U.changed(c, "authority", CITATIONS_AS_OF, 60, 1, 0)
)
on_citations(
    "agg29_risk_ranking",
    f"""{O.CLUST}, r as (select *, case when failure_mode not in {O.in_list(U.SKIP_MODE)} and failure_mode_confidence >= 0.6 then 'fm:' || failure_mode when primary_gmp_category not in {O.in_list(U.SKIP_CATEGORY)} and classification_status <> 'unconfirmed' then 'cat:' || primary_gmp_category end as key from clus where cluster_primary and source_type not in {O.in_list(R.NOT_ENFORCEMENT)}),
 g as (select key, count(*) as total, {P123}, count(*) filter (priority = 'P3') as p3, count(*) filter (classification_status = 'confirmed') as confirmed, sum(cluster_size)::bigint as cluster_rows from r where key is not null group by 1)
 select *, p1 * 1000 + p2 * 50 + p3 * 5 + confirmed * 2 + least(total, 10) as score from g order by score desc, key limit 6""",
    "full",
)(U.risk_ranking)
on_citations(
    "agg30_issue_cards",
    f"{O.CLUST}, g as (select {ISSUE} as issue, count(*) as total, sum(cluster_size)::bigint as raw_rows, {P123}, count(*) filter (coalesce(decision_summary, '') <> '') as with_summary, bool_or({PROV}) as has_provisional from clus where cluster_primary group by 1) select *, p1 * 5 + p2 * 2 + with_summary as score from g",
    "full",
)(U.issue_cards)
on_citations(
    "agg31_alert_groups",
    f"{O.CLUST}, g as (select {ISSUE} as issue, count(*) as total, {P123}, count(*) filter (classification_status = 'confirmed') as confirmed, count(distinct authority) as authorities from clus where priority = 'P1' or (priority = 'P2' and classification_status <> 'unconfirmed') group by 1) select * from g where issue <> 'Unclassified' and (p1 >= 1 or confirmed >= 2)",
    "full",
)(U.alert_groups)
on_citations("agg32_patterns", f"{O.CLUST} select company as name, 'company' as kind, count(*) as n from clus where company <> '' group by 1 having count(*) >= 3 union all select primary_gmp_category, 'category', count(*) from clus group by 1 having count(*) >= 3", "full")(U.patterns)
on_citations(
    "agg33_company_rollup",
    f"""{O.CLUST}, r as (select *, trim(coalesce(nullif(company, ''), nullif(cluster_label, ''), '')) as name from clus), g as (select name, count(*) as total, {P123}, count(distinct authority) as authorities, count(distinct primary_gmp_category) as categories, count(distinct cluster_id) as clusters, max(date) as latest from r where lower(name) not in {O.in_list(U.SKIP_COMPANY)} group by 1),
 m as (select name, facility_type from (select name, facility_type, count(*) as n, min(rec_no) as f from r group by 1, 2) qualify row_number() over (partition by name order by n desc, f) = 1)
 select g.*, m.facility_type, p1 * 3 + p2 + total as weight from g join m using (name) where total >= 3 or p1 >= 1 or categories >= 2""",
    "full",
)(U.company_rollup)
on_citations("agg34_facility_rollup", f"{O.CLUST}, b as (select facility_type, primary_gmp_category as top_category, count(*) as n, min(rec_no) as f from clus group by 1, 2) select facility_type, sum(n) over (partition by facility_type)::bigint as total, top_category from b qualify row_number() over (partition by facility_type order by n desc, f) = 1", "full")(
    U.facility_rollup
)
on_citations("agg23_heat_map", f"{O.CLUST}, top as (select primary_gmp_category from clus group by 1 order by count(*) desc, min(rec_no) limit 10) select primary_gmp_category, {', '.join(f'''count(*) filter (authority = '{a}') as {a.lower()}''' for a in AUTH)} from clus where primary_gmp_category in (from top) group by 1", "full")(lambda c: U.heat_map(c, AUTH))
on_citations("agg40_evidence_audit", f"{O.CLUST} select primary_gmp_category, count(*) as total, count(*) filter (coalesce(enriched_text, '') <> '') as with_enriched_text, count(*) filter (n_evidence > 0) as with_evidence, count(*) filter (n_evidence = 0) as no_evidence, count(*) filter (classification_confidence < 0.5 and failure_mode_confidence < 0.5) as low_confidence, count(*) filter (classification_status = 'confirmed') as confirmed, count(*) filter (classification_status = 'provisional') as provisional, count(*) filter (classification_status = 'unconfirmed') as unconfirmed from clus group by 1", "full")(U.evidence_audit)
on_citations("agg42_funnel", f"{O.CLUST} select count(*) as total, count(*) filter ({NOISELESS}) as valid, count(*) filter ({NOISELESS} and primary_gmp_category = 'Equipment & facilities') as equipment, count(*) filter ({NOISELESS} and primary_gmp_category = 'Equipment & facilities' and priority = 'P2') as p2 from clus", "full")(
    lambda c: U.funnel(c, [("valid", T.is_valid_enforcement(c) & ~T.is_low_value(c)), ("equipment", F.col("primary_gmp_category") == "Equipment & facilities"), ("p2", F.col("priority") == "P2")])
)
on_citations("agg44_missing_fields", f"{O.CIT} select count(*) filter (coalesce(company, '') = '') as missing_company, count(*) filter (date is null) as missing_date, count(*) filter (coalesce(url, '') = '') as missing_url from raw")(lambda c: U.missing_fields(c, ["company", "date", "url"]))
on_citations("srt07_top_records", f"{O.CLUST} select rec_no, priority from clus where cluster_primary order by priority, case classification_status when 'confirmed' then 0 when 'provisional' then 1 else 2 end, if(coalesce(decision_summary, '') <> '', 0, 1), date desc nulls last, id limit 5", "full")(
    lambda c: c.where("cluster_primary").orderBy(X.rank_of(F.col("priority"), ["P1", "P2", "P3", "P4"], 4), X.rank_of(F.col("classification_status"), ["confirmed", "provisional", "unconfirmed"], 3), F.when(F.coalesce("decision_summary", F.lit("")) != "", 0).otherwise(1), F.desc_nulls_last("date"), "id").limit(5).select("rec_no", "priority")
)
on_citations("srt09_order_ascending", f"{O.CIT} select rec_no from raw order by date nulls first, id limit 30")(lambda c: T.search(c, T.Facets(noise_filter=False)).limit(30).select("rec_no"))
on_citations("msc19_newest_per_category", f"{O.CLUST} select primary_gmp_category, rec_no, row_number() over (partition by primary_gmp_category order by date desc nulls last, id)::int as rank from clus qualify rank <= 3", "full")(lambda c: C.window_newest(c, ["primary_gmp_category"], 3).select("primary_gmp_category", "rec_no", "rank"))
on_citations(
    "win08_ordered_stop",
    f"{O.CIT} select rec_no from (select *, coalesce(max(case when date < date '1996-01-01' then 1 else 0 end) over (partition by authority order by rec_no rows unbounded preceding), 0) as old from raw) where old = 0",
)(lambda c: T.before_first(c, "authority", "rec_no", F.col("date") < F.lit("1996-01-01").cast("date")).select("rec_no"))


# ---- ninety-day report ------------------------------------------------------------------

_ING90 = "case when product_type = '' then 'Unknown' else product_type || ' ' || (rec_no % 41) end"


def _report(c: DataFrame) -> DataFrame:
    day = F.date_sub(F.lit(CITATIONS_AS_OF).cast("date"), 90)
    ing = F.when(F.col("product_type") == "", "Unknown").otherwise(F.concat("product_type", F.lit(" "), (F.col("rec_no") % 41).cast("string")))
    return c.where(F.col("date") >= day).withColumn("ingredient", ing)


_R90 = f"""{O.CIT}, r as (select *, {_ING90} as ingredient from raw where date >= {O.day(90)}), g as (select ingredient, count(*) filter (authority = 'TGA') as tga, count(*) filter (authority = 'FDA') as fda, count(*) filter (authority = 'EFSA') as efsa, count(*) filter (authority = 'EMA') as ema, count(*) as total, count(*) filter (date >= {O.day(30)}) as recent, count(*) filter (date < {O.day(30)}) as earlier, count(distinct authority) >= 2 as multi_jurisdiction, max(date) as last_date from r where ingredient <> 'Unknown' group by 1),
 tab as (select *, case when earlier = 0 then if(recent > 0, '↑', '—') when recent * 4 >= earlier * 3 then '↑' when recent * 4 <= earlier then '↓' else '→' end as trend from g)"""
on_citations("agg12_ingredient_authority", f"{_R90} select * from tab order by total desc, ingredient limit 20")(lambda c: N.ingredient_table(_report(c), CITATIONS_AS_OF))
on_citations("agg15_trending", f"{_R90} select ingredient, recent, total from tab where trend = '↑' and (recent >= 2 or total >= 3)")(lambda c: N.trending(N.ingredient_table(_report(c), CITATIONS_AS_OF, k=None)).select("ingredient", "recent", "total"))
on_citations("agg16_low_activity", f"{_R90} select ingredient, last_date from tab where recent = 0 and earlier >= 2 order by last_date desc, ingredient limit 10")(lambda c: N.low_activity(N.ingredient_table(_report(c), CITATIONS_AS_OF, k=None)))
on_citations("agg17_executive", f"{_R90} select count(*) as total, count(*) filter (severity = 'high') as high, count(distinct authority) as authorities from r")(lambda c: N.executive(_report(c)))
on_citations("agg14_company_targets", f"{_R90} select company, count(*) as n, array_to_string(list(id order by date desc, id), ',') as ids from r where source_type = 'warning_letter' and company <> '' group by 1")(lambda c: N.company_targets(_report(c)).withColumn("ids", F.array_join("ids", ",")))
_REPV = O.values(R.REPORT_CATEGORY, "repr")
on_citations("prj27_report_category", f"with {_REPV}, raw as ({O.citations_sql()}) select rec_no, coalesce((select label from repr where contains(lower(summary), phrase) order by ord limit 1), '') as category from raw")(lambda c: c.select("rec_no", N.report_category(F.col("summary")).alias("category")))
on_citations("agg13_report_categories", f"with {_REPV}, raw as ({O.citations_sql()}), k as (select coalesce((select label from repr where contains(lower(summary), phrase) order by ord limit 1), '') as category from raw where source_type in ('warning_letter', 'inspection_finding')) select category, count(*) as n from k where category <> '' group by 1")(
    lambda c: U.counts(c.where("source_type in ('warning_letter', 'inspection_finding')").withColumn("category", N.report_category(F.col("summary"))).where("category <> ''"), "category")
)
on_citations(
    "prj05_report_severity",
    f"{O.CIT} select rec_no, case when regexp_matches(lower(summary), '{'|'.join(x.replace('.', chr(92) + '.') for x in R.REPORT_HIGH)}') then 'high' when source_type in ('ban', 'recall') and regexp_matches(lower(summary), 'class i|serious|life') then 'high' when source_type in ('warning_letter', 'GMP_violation', 'recall') then 'medium' when regexp_matches(lower(summary), '{'|'.join(R.REPORT_LOW)}') then 'low' else 'medium' end as report_severity from raw",
)(lambda c: c.select("rec_no", N.report_severity(F.col("summary"), F.col("source_type")).alias("report_severity")))
on_citations("prj02_parse_dates", f"{O.CIT} select rec_no, date from raw where date is not null")(
    lambda c: c.where("date is not null").select(
        "rec_no",
        X.parse_date(
            F.when(F.col("rec_no") % 5 == 0, F.date_format("date", "yyyy-MM-dd")).when(F.col("rec_no") % 5 == 1, F.date_format("date", "d MMMM yyyy")).when(F.col("rec_no") % 5 == 2, F.date_format("date", "dd/MM/yyyy")).when(F.col("rec_no") % 5 == 3, F.date_format("date", "MMM d, yyyy")).otherwise(F.date_format("date", "yyyyMMdd"))
        ).alias("date"),
    )
)


# ---- sources, enrichment, queues ---------------------------------------------------------

_ENR = O.CLUST + """, el2 as (select *, length(coalesce(enriched_text, '')) as ne, 1 as one from clus), elig as (select *, case when ne > 100 and priority = 'P1' then 1 when ne > 100 and priority = 'P2' then 2 when cluster_primary then 3
  when priority in ('P1', 'P2') then 4 when source_type = 'warning_letter' then 5 else 6 end as tier from el2 where enrichment_status in ('success', 'cached') and ne > 100 and not (source_type = 'import_alert' and ne <= 500))"""


def _no_answer(c: DataFrame) -> DataFrame:
    return c.withColumn("ai_summary", F.lit(""))


on_citations("flt19_ai_gate", f"{_ENR} select rec_no, substr(sha256(substr(enriched_text, 1, 100)), 1, 16) as enriched_text_hash from elig", "full")(lambda c: E.eligible(_no_answer(c)).select("rec_no", "enriched_text_hash"))
on_citations("prj24_queue_tier", f"{_ENR} select rec_no, tier from elig", "full")(lambda c: E.eligible(_no_answer(c)).withColumn("tier", E.queue_tier()).select("rec_no", "tier"))
on_citations("srt06_ai_queue", f"{_ENR} select rec_no, tier from elig order by tier, id limit 25", "full")(lambda c: E.queue(_no_answer(c)).select("rec_no", "tier"))
_TIER = "case when source_type in ('drug_enforcement', 'device_enforcement', 'food_enforcement') then 2 when source_type in ('recall', 'safety_alert', 'compliance_action', 'inspection_finding') then 3 when source_type = 'import_alert' then 4 else 5 end + case when date > date '2000-06-01' then 10 else 0 end"
on_citations("srt05_sample", f"{O.CIT} select rec_no, {_TIER} as tier from raw order by {_TIER}, date desc nulls last, id limit 60")(lambda c: E.sample(c, 60, "enrichable", "2000-06-01").select("rec_no", E.sample_tier("2000-06-01").alias("tier")))
on_citations("prj23_sample_mixed", f"{O.CIT} select rec_no from raw order by ({_TIER}) // 3, date desc nulls last, id limit 60")(lambda c: E.sample(c, 60, "mixed", "2000-06-01").select("rec_no"))
on_citations("jon06_processed_wins", f"{O.CLUST} select raw.rec_no, coalesce(p.priority, raw.severity) as value from raw left join (select * from clus where rec_no % 4 = 0) p using (rec_no)", "full")(
    lambda c: S.coalesce_update(c.select("rec_no", F.col("severity").alias("value")), c.where("rec_no % 4 = 0").select("rec_no", F.col("priority").alias("value")), "rec_no")
)
QUERIES["prj42_json_salvage"] = lambda spark, d: tables(spark, d, "events")["events"].select("event_id", E.salvage_json(F.concat(F.lit("Sure: "), "props", F.lit(" done")), "k long")["k"].alias("k"))
SQL["prj42_json_salvage"] = "select event_id, cast(props::json->>'k' as bigint) as k from events"
QUERIES["src05_page_links"] = lambda spark, d: P.html_links(tables(spark, d, "pages")["pages"]).groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first"))
SQL["src05_page_links"] = "with l as (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages) select page_id, count(*) as links, min(href) as first from l group by 1"
QUERIES["udx05_page_title"] = lambda spark, d: tables(spark, d, "pages")["pages"].select("page_id", P.text_of(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))
SQL["udx05_page_title"] = "select page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) as title from pages"
QUERIES["flt05_relevance"] = lambda spark, d: P.relevant(tables(spark, d, "part")["part"], ["blue", "almond", "steel"], "p_name", "p_type").select("p_partkey")
SQL["flt05_relevance"] = "select p_partkey from part where regexp_matches(lower(p_name || ' ' || p_type), 'blue|almond|steel')"
QUERIES["src17_notable_papers"] = lambda spark, d: P.notable_papers(tables(spark, d, "events")["events"].select("event_id", F.col("ts").alias("date"), (F.col("event_id") % 14).alias("citations")), F.lit("2024-01-25").cast("timestamp_ntz")).select("event_id")
SQL["src17_notable_papers"] = "select event_id from events where ts >= timestamp '2024-01-25 00:00:00' or event_id % 14 >= 10 or event_id % 14 = 0"
QUERIES["win07_running_heading"] = lambda spark, d: P.running_heading(tables(spark, d, "conversations")["conversations"].select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.md5("text")).alias("heading"))).select("doc", "pos", "section")
SQL["win07_running_heading"] = "select conv_id as doc, turn as pos, last_value(case when role = 'user' then md5(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as section from conversations"
