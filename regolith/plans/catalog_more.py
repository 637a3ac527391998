"""More registered queries: display texts, joins, set operations, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import phrases as PH
from ..operators import display as D
from ..operators import facets as T
from ..operators import rollups as U
from ..operators import store as S
from ..operators import trends as G
from . import oracle as O
from .catalog import ISSUE, QUERIES, SQL, on_citations, on_signals
from .views import CITATIONS_AS_OF, SIGNALS_AS_OF, signals, tables

CLAIMS = {"identity": ["notice", "click"], "buying": ["purchase"], "harm": ["error", "signup"]}

on_citations("prj15_context_text", f"{O.TEXTS} select rec_no, length(context_text)::int as n from t where context_text <> ''", "classified")(lambda c: c.where("context_text <> ''").select("rec_no", F.length("context_text").alias("n")))


on_citations("prj40_buckets", f"{O.CIT}, g as (select authority, count(*) as n, count(*) filter (severity = 'high') as h from raw group by 1) select authority, case when n >= 200 then 'Very High' when n >= 100 then 'High' when n >= 40 then 'Moderate' when n >= 10 then 'Low' else 'Minimal' end as volume, case when h > 0.4 * n or h > 5 then 'Critical' when h > 0.2 * n or h > 2 then 'High' else 'Watch' end as impact from g")(
    lambda c: c.groupBy("authority").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("h")).select("authority", U.volume_bucket(F.col("n")).alias("volume"), U.risk_impact(F.col("n"), F.col("h")).alias("impact"))
)
on_citations("prj41_movement", f"{O.CIT}, g as (select authority, count(*) filter (date >= {O.day(60)}) as a, count(*) filter (date < {O.day(60)}) as b from raw where date >= {O.day(120)} group by 1) select authority, case when b = 0 then 'new this period' when a = 0 then 'no recent activity' when abs(a - b) <= 2 then 'stable' when a > b then '+' || (a - b) || ' vs prior' else (a - b) || ' vs prior' end as movement from g")(
    lambda c: U.changed(c, "authority", CITATIONS_AS_OF, 60, -1, -1).select("authority", U.movement(F.col("curr"), F.col("prior")).alias("movement"))
)
_NARR = "(select string_agg(ingredient_name, ', ' order by o) from (select ingredient_name, min(rec_no) as o from s where coalesce(ingredient_name, '') <> '' and lower(trim(ingredient_name)) <> 'unknown' group by 1 order by o limit 5))"
on_signals(
    "prj46_narrative",
    f"{O.SIG}, c as (select count(*) as n, count(*) filter (severity = 'high') as h, count(*) filter (severity = 'medium') as m from s) select 'This period saw ' || n || ' new regulatory signals from ' || (select string_agg(a || ' (' || k || ')', ', ' order by k desc, o) from (select upper(authority) as a, count(*) as k, min(rec_no) as o from s group by 1)) || ', ' || h || ' HIGH and ' || m || ' MEDIUM and ' || (n - h - m) || ' LOW severity; key ingredients include ' || {_NARR} || '.' as narrative from c",
)(D.narrative)
on_signals("agg19_claim_ranking", f"{O.SIG}, r as (select unnest(['identity', 'buying', 'harm']) as category, * from s), m as (select category, count(*) as total, count(*) filter (severity = 'high') as high from r where (category = 'identity' and regexp_matches(lower(title), 'notice|click')) or (category = 'buying' and contains(lower(title), 'purchase')) or (category = 'harm' and regexp_matches(lower(title), 'error|signup')) group by 1) select *, case when high * 2 > total then 'H' when high * 5 > total then 'M' else 'L' end as risk from m")(
    lambda s: D.claim_ranking(s, CLAIMS, ["title"])
)
on_signals("flt15_loose_match", f"{O.SIG} select rec_no from s where contains(lower(title), 'almond') or contains(lower(title), 'error')")(lambda s: s.where(D.loose_match(D.signal_text(["title"]), "almond/error")).select("rec_no"))
on_signals("flt16_strict_match", f"{O.SIG} select rec_no from s where lower(trim(ingredient_name)) = 'error' or regexp_matches(lower(title), '(^|[\\s,.(/\\-])error([\\s,.)/\\-0-9]|$)')")(lambda s: s.where(D.strict_match(D.signal_text(["title"]), F.col("ingredient_name"), "error")).select("rec_no"))
on_signals(
    "msc26_why_it_matters",
    f"""{O.SIG}, g as (select ing as ingredient, count(*) as t, count(*) filter (severity = 'high') as h, count(*) filter (sentiment = 'negative') as n from s where ing is not null group by 1)
 select ingredient, case when h > 2 then h || ' high-severity alerts — review labeling and claims for compliance exposure now.' when n * 10 > t * 6 then 'Majority negative sentiment (' || cast(round(n * 100.0 / t) as int) || '%) — monitor for enforcement or claim challenge risk.' else t || ' signal' || if(t > 1, 's', '') || ' tracked across regulatory, research and adverse event sources.' end as why from g""",
)(
    lambda s: s.select(X.norm_key("ingredient_name").alias("ingredient"), "severity", "sentiment").where("ingredient is not null").groupBy("ingredient").agg(F.count("*").alias("t"), F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("sentiment") == "negative").alias("n")).select("ingredient", D.why_it_matters(F.col("t"), F.col("h"), F.col("n"), F.lit("stable")).alias("why"))
)
on_signals("msc27_entity_drilldown", f"{O.SIG} select authority, count(*) as n, max(scraped_at) as newest from s where ing = 'unknown' or regexp_matches(lower(title), '(^|[\\s,.(/\\-])click([\\s,.)/\\-0-9]|$)') group by 1")(
    lambda s: s.where(D.strict_match(D.signal_text(["title"]), F.col("ingredient_name"), "click")).groupBy("authority").agg(F.count("*").alias("n"), F.max("scraped_at").alias("newest"))
)
on_signals("msc31_review_queue", f"{O.SIG} select source_id from s where {O.S7} order by scraped_at desc, rec_no limit 50")(lambda s: G.recent(s, SIGNALS_AS_OF, 7).orderBy(F.desc("scraped_at"), "rec_no").limit(50).select("source_id"))
on_signals("srt01_newest_first", f"{O.SIG} select source_id from s order by scraped_at desc, rec_no limit 25")(lambda s: s.orderBy(F.desc("scraped_at"), "rec_no").limit(25).select("source_id"))
on_signals("srt04_fixed_order", f"{O.SIG} select authority, case authority when 'fda' then 0 when 'tga' then 1 else 2 end as place, count(*) as n from s group by 1, 2 order by 2, min(rec_no)")(
    lambda s: s.groupBy("authority").agg(F.count("*").alias("n"), F.min("rec_no").alias("o")).withColumn("place", X.rank_of(F.col("authority"), ["fda", "tga"], 2)).orderBy("place", "o").select("authority", "place", "n")
)
on_signals("set01_union_all", f"{O.SIG} select authority, count(*) as n from (select * from s where severity = 'high' union all select * from s where authority = 'tga') group by 1")(lambda s: s.where("severity = 'high'").unionByName(s.where("authority = 'tga'")).groupBy("authority").agg(F.count("*").alias("n")))
on_signals("set02_union_keep_first", f"{O.SIG} select url, min(rec_no) as rec_no from (select * from s where severity = 'high' union all select * from s where authority = 'tga') group by 1")(
    lambda s: T.keep_first(s.where("severity = 'high'").unionByName(s.where("authority = 'tga'")), F.col("url"), F.col("rec_no")).select("url", "rec_no")
)
on_signals("set04_difference", f"{O.SIG} select ing as ingredient from s where ing is not null and {O.S7} except select ing from s where not ({O.S7})")(
    lambda s: G.recent(s, SIGNALS_AS_OF, 7).select(X.norm_key("ingredient_name").alias("ingredient")).where("ingredient is not null").distinct().join(s.where(F.col("scraped_at") < G.since(SIGNALS_AS_OF, 7)).select(X.norm_key("ingredient_name").alias("ingredient")).distinct(), "ingredient", "left_anti")
)
on_signals("set05_keyword_union", f"{O.SIG} select rec_no from s where regexp_matches(lower(title), 'almond|error|blue')")(
    lambda s: s.where(F.exists(F.array_union(F.array(F.lit("almond"), F.lit("error")), F.array(F.lit("blue"), F.lit("error"))), lambda k: F.lower("title").contains(k))).select("rec_no")
)
on_signals("set03_key_union", f"{O.SIG}, a as (select ing as ingredient, count(*) as curr from s where ing is not null and {O.S7} group by 1), b as (select ing as ingredient, count(*) as prev from s where ing is not null and not ({O.S7}) group by 1) select coalesce(a.ingredient, b.ingredient) as ingredient, coalesce(curr, 0) as curr, coalesce(prev, 0) as prev from a full join b on a.ingredient = b.ingredient")(
    lambda s: s.select(X.norm_key("ingredient_name").alias("ingredient"), "scraped_at").where("ingredient is not null").groupBy("ingredient").agg(F.count_if(F.col("scraped_at") >= G.since(SIGNALS_AS_OF, 7)).alias("curr"), F.count_if(F.col("scraped_at") < G.since(SIGNALS_AS_OF, 7)).alias("prev"))
)
on_signals("snk04_update_summary", f"{O.SIG}, o as (select * from s qualify row_number() over (partition by url order by rec_no) = 1) select url, case when coalesce(ai_summary, '') = '' then 'filled ' || rec_no else ai_summary end as ai_summary from o")(
    lambda s: _filled(T.keep_first(s, F.col("url"), F.col("rec_no")))
)


def _filled(one: DataFrame) -> DataFrame:
    changes = S.missing(one, "ai_summary").select("url", F.concat(F.lit("filled "), F.col("rec_no").cast("string")).alias("ai_summary"))
    return S.update(one, changes, "url").select("url", "ai_summary")


on_signals("str01_fresh_cache", f"{O.SIG} select rec_no from s where floor(epoch(timestamp '{SIGNALS_AS_OF}' - scraped_at) / 86400) < 10")(lambda s: S.fresh_cache(s.withColumnRenamed("scraped_at", "cached_at"), SIGNALS_AS_OF, 10).select("rec_no"))
on_signals("str02_sliding_windows", f"{O.SIG}, w as (select ing as ingredient, unnest(generate_series(date_trunc('day', scraped_at) - interval 29 day, date_trunc('day', scraped_at), interval 1 day)) as start from s where ing is not null) select strftime(start, '%Y-%m-%d') as start, ingredient, count(*) as n from w group by 1, 2")(
    lambda s: G.rolling_windows(s).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "ingredient", "n")
)
on_signals("msc29_source_label", f"{O.SIG} select rec_no, case authority when 'tga' then 'TGA Australia' when 'fda' then 'US FDA' else 'Unknown Source' end as source_label from s")(
    lambda s: D.source_label(s, s.sparkSession.createDataFrame([("tga", "TGA Australia"), ("fda", "US FDA")], "authority string, label string")).select("rec_no", "source_label")
)
on_signals("jon09_conditional_lookup", f"{O.ROLLING} select ingredient, count_7d, count_30d - count_7d as earlier from rolling")(lambda s: G.rolling_counts(s, SIGNALS_AS_OF).select("ingredient", "count_7d", (F.col("count_30d") - F.col("count_7d")).alias("earlier")))


def _small(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


on_citations("jon04_enrichment_join", f"{O.CIT} select raw.rec_no, coalesce(nullif(e.enriched_text, ''), 'none') as text from raw left join (select id, enriched_text from raw where rec_no % 2 = 0) e using (id)")(
    lambda c: c.select("id", "rec_no").join(c.where("rec_no % 2 = 0").select("id", "enriched_text"), "id", "left").select("rec_no", F.coalesce(X.blank_to_null("enriched_text"), F.lit("none")).alias("text"))
)
on_citations("jon05_two_key_join", f"{O.CIT} select rec_no, rec_no % 2 = 0 as cached from raw")(
    lambda c: c.withColumn("h", F.md5("summary")).join(c.where("rec_no % 2 = 0").select("id", F.md5("summary").alias("h"), F.lit(True).alias("hit")), ["id", "h"], "left").select("rec_no", F.coalesce("hit", F.lit(False)).alias("cached"))
)
on_citations("jon08_rule_matches", f"{O.CIT} select catr.label, count(distinct rec_no) as n from raw, catr where contains(lower(summary), phrase) group by 1")(
    lambda c: c.select("rec_no", F.explode(PH.ranked(F.lower("summary"), _category_rules())).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
)


def _category_rules():
    from ..functions.rules import CATEGORY

    return CATEGORY


on_citations("jon11_rows_with_counts", f"{O.CIT} select rec_no, count(*) over (partition by nullif(lower(trim(company)), '')) as n from raw where trim(company) <> ''")(
    lambda c: _with_counts(c.where("trim(company) <> ''").withColumn("k", F.lower(F.trim("company"))))
)


def _with_counts(c: DataFrame) -> DataFrame:
    return c.join(c.groupBy("k").agg(F.count("*").alias("n")), "k").select("rec_no", "n")


on_citations("jon12_dimension_join", f"{O.CLUST} select rec_no, case primary_gmp_category when 'Equipment & facilities' then 'review plant' when 'Labelling & claims' then 'review label' end as advice from clus", "full")(
    lambda c: c.join(F.broadcast(_small(c.sparkSession, [("Equipment & facilities", "review plant"), ("Labelling & claims", "review label")], "primary_gmp_category string, advice string")), "primary_gmp_category", "left").select("rec_no", "advice")
)
on_citations("jon13_profile_fallback", f"{O.CIT} select rec_no, case facility_type when 'CMO' then 'contract' else 'general ' || lower(facility_type) end as profile from raw")(
    lambda c: c.join(F.broadcast(_small(c.sparkSession, [("CMO", "contract")], "facility_type string, p string")), "facility_type", "left").select("rec_no", F.coalesce("p", F.concat(F.lit("general "), F.lower("facility_type"))).alias("profile"))
)
on_citations("agg35_top_mode", f"{O.CLUST} select failure_mode, count(*) as n from clus where failure_mode not in ('', 'insufficient_detail', 'other') group by 1 order by n desc, min(rec_no) limit 1", "full")(lambda c: U.top_counts(c.where(~F.col("failure_mode").isin("", "insufficient_detail", "other")), "failure_mode", 1, "rec_no"))
on_citations("agg37_authority_categories", f"{O.CLUST}, b as (select authority, primary_gmp_category, count(*) as n, min(rec_no) as f from clus group by 1, 2) select authority, sum(n)::bigint as total, array_to_string((list(primary_gmp_category order by n desc, f))[1:3], '|') as top from b group by 1", "full")(
    lambda c: c.groupBy("authority", "primary_gmp_category").agg(F.count("*").alias("n"), F.min("rec_no").alias("f")).groupBy("authority").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "f", "primary_gmp_category"))), 1, 3), lambda x: x["primary_gmp_category"]), "|").alias("top"))
)
on_citations("agg38_focus_counts", f"{O.CLUST} select count(*) as total, count(*) filter (cluster_primary) as primaries, count(*) filter (priority = 'P1') as p1, count(*) filter (priority = 'P2') as p2, count(distinct authority) as authorities from clus where facility_type = 'CMO'", "full")(
    lambda c: U.kpis(c.where("facility_type = 'CMO'")).select("total", "primaries", "p1", "p2", "authorities")
)
on_citations("agg41_source_audit", f"{O.CLUST} select source_type, count(*) as total, count(*) filter (priority in ('P1', 'P2')) as top, count(*) filter (classification_status = 'unconfirmed') as unconfirmed from clus group by 1", "full")(
    lambda c: c.groupBy("source_type").agg(F.count("*").alias("total"), F.count_if(F.col("priority").isin("P1", "P2")).alias("top"), F.count_if(F.col("classification_status") == "unconfirmed").alias("unconfirmed"))
)
on_citations("flt14_evidence_backed", f"{O.CLUST}, e as (select *, (select bool_or(contains(phrase, 'equipment') or contains(phrase, 'calibration')) from evir where label = primary_gmp_category and contains(lower(best_text), phrase)) as a, (select bool_or(contains(phrase, 'equipment') or contains(phrase, 'calibration')) from modr where label = failure_mode and contains(lower(best_text), phrase)) as b from clus) select rec_no from e where classification_status <> 'unconfirmed' and (coalesce(a, false) or coalesce(b, false))", "full")(
    lambda c: D.evidence_backed(c, ["equipment", "calibration"]).where("backed").select("rec_no")
)
on_citations(
    "flt22_suspicious",
    f"""{O.CLUST}, r as (select rec_no, concat_ws(',', case when primary_gmp_category = 'Deviation management' and n_evidence = 0 then 'R1' end, case when primary_gmp_category = 'Quality management system' and {O._GUIDE} then 'R2' end, case when source_type = 'inspection_finding' and {O._GUIDE} then 'R3' end,
 case when n_evidence = 0 and classification_confidence < 0.5 and primary_gmp_category <> 'Other / Insufficient Detail' then 'R4' end, case when source_type = 'inspection_finding' and authority in ('EFSA', 'BfR') then 'R5' end, case when failure_mode not in ('', 'insufficient_detail') and failure_mode_confidence < 0.2 and primary_gmp_category <> 'Other / Insufficient Detail' then 'R6' end) as reasons from clus) select * from r where reasons <> ''""",
    "full",
)(lambda c: D.suspicious_reasons(c).select("rec_no", F.array_join("reasons", ",").alias("reasons")))
on_citations("msc04_inferred_status", f"{O.CLUST} select rec_no, case when n_evidence = 0 and primary_gmp_category <> 'Other / Insufficient Detail' then 'unconfirmed' when n_evidence > 0 and (length(best_text) > 200 or classification_confidence >= 0.5) then 'confirmed' else 'provisional' end as status from clus", "full")(lambda c: c.select("rec_no", D.inferred_status(c).alias("status")))
on_citations("msc07_best_filter", f"{O.CLUST}, b as (select 'failure_mode' as kind, 0 as r, failure_mode as value, count(*) as n from clus where failure_mode <> '' group by 3 union all select 'primary_gmp_category', 1, primary_gmp_category, count(*) from clus group by 3) select kind, value, n from b order by n desc, r, value limit 1", "full")(D.best_filter)
on_citations("msc12_primaries", f"{O.CLUST} select rec_no from clus where cluster_primary", "full")(lambda c: c.where(F.coalesce("cluster_primary", F.lit(True))).select("rec_no"))
on_citations("msc14_cluster_badges", f"{O.CLUST} select cluster_id, '×' || count(*) || ' ' || if(count(distinct source_type) = 1, min(source_type), 'related records') as badge from clus where cluster_id is not null group by 1", "full")(
    lambda c: c.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").cast("string").alias("n"), F.count_distinct("source_type").alias("k"), F.min("source_type").alias("t")).select("cluster_id", F.concat(F.lit("×"), "n", F.lit(" "), F.when(F.col("k") == 1, F.col("t")).otherwise("related records")).alias("badge"))
)
_NOT_ISSUES = "('Unclassified', 'Other', 'Limited detail', 'Other / Insufficient Detail', 'GMP violations', '')"
on_citations("msc16_issue_options", f"{O.CLUST} select distinct {{ISSUE}} as issue from clus where {{ISSUE}} not in {_NOT_ISSUES}".replace("{ISSUE}", ISSUE), "full")(
    lambda c: c.select(T.base_issue(T.display_issue()).alias("issue")).where(f"issue not in {_NOT_ISSUES}").distinct()
)
on_citations("msc18_issue_actions", f"{O.CIT} select distinct source_type as issue, case source_type when 'recall' then 'trace lots' when 'import_alert' then 'check imports' else 'review evidence' end as action from raw")(
    lambda c: D.issue_action(c.select(F.col("source_type").alias("issue")).distinct(), _small(c.sparkSession, [(0, "import", "check imports"), (1, "recall", "trace lots")], "ord int, label string, action string"), "review evidence")
)
on_citations("msc21_source_counts", f"{O.CIT} select source_type, count(*) as n from raw group by 1")(lambda c: U.counts(c, "source_type"))
on_citations("msc40_report_order", f"{O.CIT} select rec_no from raw order by authority, date desc nulls last, id limit 40")(lambda c: c.orderBy("authority", F.desc_nulls_last("date"), "id").limit(40).select("rec_no"))
on_citations("win03_recurrence_minus_self", f"{O.RECUR} select recurrence_count_company_90d as n, count(*) as rows from rec group by 1", "priority")(lambda c: _recur(c).groupBy(F.col("recurrence_count_company_90d").alias("n")).agg(F.count("*").alias("rows")))


def _recur(c: DataFrame) -> DataFrame:
    from ..operators.citations import recurrence

    return recurrence(c, CITATIONS_AS_OF)


QUERIES["prj45_few_shot"] = lambda spark, d: D.few_shot(tables(spark, d, "labels")["labels"].where("quality = 0").orderBy("doc_id").limit(5).select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("incorrect").alias("rating"), F.lit("note").alias("correction_note")))
SQL["prj45_few_shot"] = "select string_agg('Example ' || doc_id || ' (marked as incorrect): doc ' || doc_id || ' — note', chr(10) order by doc_id) as examples from (select doc_id from labels where quality = 0 order by doc_id limit 5)"
QUERIES["prj26_ingredient_rules"] = lambda spark, d: signals(spark, d).select("rec_no", D.ingredient(F.col("title"), [("Almond", ["almond"]), ("Blue", ["blue", "navy"]), ("Event", ["error"])]).alias("ingredient"))
SQL["prj26_ingredient_rules"] = f"{O.SIG} select rec_no, case when contains(lower(title), 'almond') then 'Almond' when regexp_matches(lower(title), 'blue|navy') then 'Blue' when contains(lower(title), 'error') then 'Event' else 'Unknown' end as ingredient from s"
