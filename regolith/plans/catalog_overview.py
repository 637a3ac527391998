"""Registered queries of the overview: trend labels, cards, actions, model-call accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import display as D
from ..operators import enrich as E
from ..operators import facets as T
from ..operators import overview as V
from ..operators import rollups as U
from . import oracle as O
from .catalog import ISSUE, NOISELESS, on_citations, on_signals

_MAP = ", ".join(f"({O.quoted(x)}, {O.quoted(k)}, {O.quoted(v)}, {i})" for x, (cats, modes) in V.TREND_FILTERS.items() for i, (k, vs) in enumerate((("failure_mode", modes), ("primary_gmp_category", cats))) for v in vs)
_OWN = ", ".join(f"({O.quoted(x)}, 'primary_gmp_category', {O.quoted(x)}, 2)" for x in V.TREND_FILTERS)
_TREND = f"""{O.CLUST}, tm(label, kind, value, tier) as (values {_MAP}, {_OWN}), leg as (select * replace (case when rec_no % 5 = 0 then '' else primary_gmp_category end as primary_gmp_category), case when rec_no % 7 = 0 then '' when rec_no % 3 = 0 then 'GMP violations' else primary_gmp_category end as category from clus),
 every as (select * replace (coalesce(nullif(primary_gmp_category, ''), category) as primary_gmp_category) from leg), pool as (select * from every where {{where}}),
 cnt as (select 'failure_mode' as kind, failure_mode as value, count(*) as n, min(rec_no) as first from pool where failure_mode <> '' group by 2 union all select 'primary_gmp_category', primary_gmp_category, count(*), min(rec_no) from pool where primary_gmp_category <> '' group by 2),
 best as (select label, kind, value, n from tm join cnt using (kind, value) qualify row_number() over (partition by label order by tier = 2, n desc, tier, first) = 1)"""
LABELS = list(V.TREND_FILTERS)


#: The noise filter over a table with the legacy category, whose words count as well.
_CLEAN = NOISELESS.replace("regexp_matches(lower(summary), '", "regexp_matches(lower(coalesce(summary, '') || ' ' || category), '")


def legacy(c: DataFrame) -> DataFrame:
    """Some rows with the legacy category alone, some with one that differs."""
    old = F.when(F.col("rec_no") % 7 == 0, "").when(F.col("rec_no") % 3 == 0, "GMP violations").otherwise(F.col("primary_gmp_category"))
    return c.withColumns({"category": old, "primary_gmp_category": F.when(F.col("rec_no") % 5 == 0, "").otherwise(F.col("primary_gmp_category"))})


def _matches(c: DataFrame) -> DataFrame:
    return c.agg(*[F.count_if(V.trend_match(c, x)).alias(f"n{i}") for i, x in enumerate(LABELS)])


_MATCH = ", ".join(f"count(*) filter (primary_gmp_category in {O.in_list(cats)} or failure_mode in {O.in_list(modes)}) as n{i}" for i, (cats, modes) in enumerate(V.TREND_FILTERS.values()))
on_citations("msc06_trend_match", f"{_TREND.format(where='true')} select {_MATCH} from every", "full")(lambda c: _matches(legacy(c)))
on_citations("msc08_trend_filters", f"{_TREND.format(where='true')} select label, kind, value, n::bigint as n from best", "full")(lambda c: V.trend_filters(legacy(c), LABELS))
on_citations(
    "msc09_grouped_broader",
    f"{_TREND.format(where='cluster_primary and ' + _CLEAN.replace('{', '{{').replace('}', '}}'))}, wide as (select category as label, count(*) as broader from leg where {_CLEAN} group by 1) select label, coalesce(n, 0)::bigint as grouped, coalesce(broader, 0)::bigint as broader from (select distinct label from tm) left join best using (label) left join wide using (label)",
    "full",
)(lambda c: V.grouped_and_broader(legacy(c), LABELS))

_FACETS = T.Facets(authority="FDA", severity="high", priority=("P1", "P2"), category="Sterility assurance")
_OPEN = {"noise": NOISELESS, "authority": "authority = 'FDA'", "severity": "severity = 'high'", "priority": "priority in ('P1', 'P2')", "category": "primary_gmp_category = 'Sterility assurance'"}
on_citations(
    "msc10_facet_counts",
    f"{O.CLUST} " + " union all ".join(f"select '{name}' as facet, {column} as value, count(*) as n from clus where {' and '.join(f'({x})' for k, x in _OPEN.items() if k != name)} and {column} <> '' group by 2" for name, column in T.COUNTED.items()),
    "full",
)(lambda c: T.facet_counts(c, _FACETS))
on_citations("msc10_base_pool", f"{O.CLUST} select rec_no from clus where {NOISELESS}", "full")(lambda c: T.base_pool(c).select("rec_no"))

_INTEL = {"Ingredient safety": "Identity and purity are open. Test first.", "Labelling & claims": "Claims need proof. Review."}
_RED = "(length({0}) < 4 or (primary_gmp_category <> '' and (lower({0}) = lower(primary_gmp_category) or regexp_replace(lower({0}), '[.,;:\\s]+$', '') = lower(primary_gmp_category))))"
_GOOD = "(length({0}) > 25 and not " + _RED + ")"
_TEXT = "coalesce(nullif(trim(decision_summary), ''), trim(summary))"
on_citations(
    "msc13_meaningful_detail",
    f"""{O.CLUST}, mem as (select cluster_id, arg_min({_TEXT}, rec_no) as m from clus where cluster_id is not null and not cluster_primary and {_GOOD.format(_TEXT)} group by 1)
 select rec_no, case when {_GOOD.format('trim(violation_details)')} then substr(trim(violation_details), 1, 130) when {_GOOD.format('trim(decision_summary)')} then substr(trim(decision_summary), 1, 130) when cluster_primary and m is not null then substr(m, 1, 130)
  when primary_gmp_category = 'Labelling & claims' then 'Claims need proof.' when primary_gmp_category = 'Ingredient safety' then 'Identity and purity are open.' else 'Grouped regulatory records — ' || replace(source_type, '_', ' ') end as detail from clus left join mem using (cluster_id)""",
    "full",
)(lambda c: V.meaningful_detail(c, _INTEL).select("rec_no", "detail"))

_SHOWN = f"{O.CLUST}, i as (select *, {ISSUE} as issue from clus), shown as (select * from i qualify row_number() over (partition by issue, coalesce(cluster_id, id) order by not cluster_primary, rec_no) = 1)"
_VIS = "count(*) as visible, count(*) filter (priority = 'P1') as p1, count(*) filter (priority = 'P2') as p2, count(*) filter (priority = 'P3') as p3, count(*) filter (classification_status = 'confirmed') as confirmed, count(*) filter (classification_status = 'provisional') as provisional"
on_citations("msc15_visible_counts", f"{_SHOWN} select issue, {_VIS} from shown group by 1", "full")(V.visible_counts)


def _top(col: str, k: int) -> str:
    return f"(select string_agg(v, ', ' order by n desc, first) from (select {col} as v, count(*) as n, min(rec_no) as first from shown s where s.issue = g.issue and {col} <> '' group by 1 order by n desc, first limit {k}))"


on_citations(
    "msc17_alert_cards",
    f"{_SHOWN}, g as (select issue, {_VIS} from shown group by 1) select g.*, {_top('authority', 4)} as authorities, {_top('facility_type', 3)} as facilities, case when p1 > 0 then 'P1' else 'P2' end as top_priority from g",
    "full",
)(V.alert_cards)
on_citations("msc17_card_preview", f"{_SHOWN} select issue, row_number() over (partition by issue order by priority, date desc nulls last, rec_no)::int as place, id from shown qualify place <= 5", "full")(V.card_preview)


def _lead(col: str) -> str:
    return f"(select v from (select {col} as v, count(*) as n, min(rec_no) as first from clus group by 1 order by n desc, first limit 1))"


on_citations(
    "msc20_strip",
    f"""{O.CLUST}, c as (select * from clus qualify row_number() over (partition by coalesce(cluster_id, id) order by not cluster_primary, rec_no) = 1)
 select count(*) as records, count(*) filter (priority = 'P1') as p1_records, (select count(*) from c) as visible, (select count(*) from c where priority = 'P1') as p1_visible,
  {_lead("coalesce(nullif(primary_gmp_category, ''), 'Other')")} as top_category, {_lead('authority')} as top_authority, {_lead("replace(source_type, '_', ' ')")} as top_source_type from clus""",
    "full",
)(V.strip)

_ACTIONS = """{head}, tt as (select * from clus where {where}), n as (select count(*) filter (cluster_primary and priority = 'P1') as p1, count(*) filter (cluster_primary and priority = 'P2') as p2, count(*) filter (severity = 'high') as h, count(*) filter (facility_type = 'Supplement / Nutraceutical') as s, count(*) filter (authority = 'TGA') as a from tt),
 l as (select primary_gmp_category as cat, count(*) as n from tt where primary_gmp_category not in ('', 'Other', '{none}') group by 1 order by n desc, min(rec_no) limit 1),
 x as (select 0 as place, 'now' as urgency, case when p1 + p2 > 0 then 'Review ' || p1 || ' high-priority' || if(p2 > 0, ' + ' || p2 || ' needs-review', '') || ' GMP enforcement cluster' || if(p1 + p2 <> 1, 's', '') || ' requiring decision'
   else (select 'Review ' || cat || ' — ' || l.n || ' citation' || if(l.n <> 1, 's', '') from l) end as title from n
  union all select 1, 'urgent', if(h > 0, h || ' high-severity action' || if(h <> 1, 's', '') || ' require immediate attention', null) from n
  union all select 2, 'this-week', case when s >= a and s > 0 then s || ' Supplement / Nutraceutical action' || if(s <> 1, 's', '') when a > 0 then a || ' TGA action' || if(a <> 1, 's', '') || ' on file — AU market priority' end from n)
 select place::int as place, urgency, title from x where title is not null"""
on_citations("agg39_immediate_actions", _ACTIONS.format(head=O.CLUST, where="true", none=R.NO_DETAIL), "full")(lambda c: V.immediate_actions(c, {}))
on_citations("agg39_without_urgent_clusters", _ACTIONS.format(head=O.CLUST, where="priority not in ('P1', 'P2') and authority <> 'FDA'", none=R.NO_DETAIL), "full")(lambda c: V.immediate_actions(c.where("priority not in ('P1', 'P2') and authority <> 'FDA'"), {}))
on_citations("flt20_enrichable", f"{O.CIT} select rec_no from raw where case authority when 'FDA' then source_type = 'warning_letter' when 'TGA' then source_type in ('compliance_action', 'safety_alert', 'recall') else false end")(lambda c: V.enrichable(c).select("rec_no"))
on_citations("flt25_static_items", f"{O.CIT} select rec_no from raw where severity = 'high' and authority = 'TGA'")(lambda c: V.static_items(c, severity="high", authority="TGA", source_type="all").select("rec_no"))


def _sections(c: DataFrame) -> DataFrame:
    items = c.groupBy("severity", "source_type").agg(F.min("rec_no").alias("ord"))
    return V.static_sections(items.select(F.col("severity").alias("priority"), "ord", F.col("source_type").alias("title")))


on_citations("msc24_static_sections", f"{O.CIT}, t as (select severity, source_type, min(rec_no) as ord from raw group by 1, 2) select severity as section, (case severity when 'high' then 1 when 'medium' then 2 else 3 end)::int as place, string_agg(source_type, '; ' order by ord) as titles from t group by 1")(_sections)
_WORDS = "case " + " ".join(f"when {' or '.join(f'contains(a, {O.quoted(w)})' for w in label.lower().split() if len(w) > 3)} then {O.quoted(label)}" for label, _ in R.CATEGORY if any(len(w) > 3 for w in label.lower().split())) + " end"
_EXACT = "case " + " ".join(f"when a = {O.quoted(label.lower())} then {O.quoted(label)}" for label, _ in R.CATEGORY) + " end"
_ANSWER = [x for x, _ in R.CATEGORY][:4]
on_citations(
    "msc34_answered_category",
    f"""{O.CIT}, t as (select rec_no, summary, case rec_no % 6 when 0 then {O.quoted(_ANSWER[0].upper())} when 1 then {O.quoted(_ANSWER[1])} when 2 then 'about ' || lower({O.quoted(_ANSWER[2])}) when 3 then 'no idea' when 4 then summary else '' end as ans from raw),
 u as (select *, lower(trim(ans)) as a from t) select rec_no, coalesce({_EXACT}, {_WORDS}, (select label from catr where contains(lower(summary), phrase) order by ord limit 1), 'GMP violations') as category from u""",
)(lambda c: c.select("rec_no", V.answered_category(_answers(), F.col("summary")).alias("category")))


def _answers():
    k = F.col("rec_no") % 6
    return F.when(k == 0, _ANSWER[0].upper()).when(k == 1, _ANSWER[1]).when(k == 2, "about " + _ANSWER[2].lower()).when(k == 3, "no idea").when(k == 4, F.col("summary")).otherwise("")


on_citations(
    "msc35_call_counters",
    f"{O.CIT} select case authority when 'FDA' then 'scraping' when 'TGA' then 'enrichment' else 'intelligence' end as phase, severity as tier, count(*) filter (enrichment_status in ('success', 'cached')) as calls, count(*) filter (enrichment_status = 'success') as accepted, count(*) filter (enrichment_status = 'cached') as discarded, count(*) filter (enrichment_status not in ('success', 'cached')) as skipped from raw group by 1, 2",
)(lambda c: V.call_counters(c.select(F.when(F.col("authority") == "FDA", "scraping").when(F.col("authority") == "TGA", "enrichment").otherwise("other").alias("phase"), F.col("severity").alias("tier"), F.when(F.col("enrichment_status") == "success", "accepted").when(F.col("enrichment_status") == "cached", "discarded").otherwise("skipped").alias("outcome"))))
on_signals("msc39_prompt", f"{O.SIG} select rec_no, 'Source ' || authority || ': ' || title || chr(10) || substr(repeat(title || ' ', 200), 1, 3000) as prompt from s")(
    lambda s: s.withColumn("body_text", F.repeat(F.concat("title", F.lit(" ")), 200)).select("rec_no", V.prompt("Source {authority}: {title}\n{body}").alias("prompt"))
)
_RAWT = "case when rec_no % 4 = 0 then 'Positive signal for VMS' else coalesce(ai_summary, '') end"
_KIND = "case when coalesce(event_type, '') in ('', 'other') then 'research signal' else replace(event_type, '_', ' ') end"
_NAME = "case when coalesce(ingredient_name, '') in ('', 'unknown') then '' else ingredient_name end"
on_signals(
    "prj38_own_words",
    f"""{O.SIG}, t as (select *, coalesce(nullif({_RAWT}, ''), case when rec_no % 3 = 0 then 'Reason: ' || title when rec_no % 7 = 0 then 'Clinical trial on vitamin B' end, '') as r, {_KIND} as kind, {_NAME} as nm, upper(authority) as lab from s)
 select rec_no, case when r <> '' and not regexp_matches(lower(r), 'positive signal for vms|clinical trial on vitamin b') then r
  when severity = 'high' then lab || ': ' || kind || if(nm <> '', ' on ' || nm, '') || ' — ' || if(sentiment = 'negative', 'Immediate portfolio review required', 'Monitor for compliance impact')
  when nm <> '' then lab || ': ' || kind || ' on ' || nm || ' — ' || case sentiment when 'positive' then 'Supports efficacy dossiers and marketing claims' when 'negative' then 'Flag for regulatory risk assessment' else 'Track for market and formulation implications' end
  else lab || ': ' || regexp_replace(substr(title, 1, 55), '\\s+\\S*$', '') || ' — ' || case sentiment when 'positive' then 'Positive evidence for claims substantiation' when 'negative' then 'Adverse signal requiring compliance monitoring' else 'Track for VMS regulatory implications' end end as why from t""",
)(lambda s: s.withColumn("ai_summary", F.when(F.col("rec_no") % 4 == 0, "Positive signal for VMS").otherwise(F.col("ai_summary"))).withColumn("sentiment_reasoning", F.when(F.col("rec_no") % 3 == 0, F.concat(F.lit("Reason: "), "title")).when(F.col("rec_no") % 7 == 0, "Clinical trial on vitamin B")).select("rec_no", V.own_words(F.upper("authority")).alias("why")))
on_citations(
    "msc22_insight_counts",
    f"{O.CLUST} select count(*) as total, count(*) filter (priority = 'P1') as p1, count(*) filter (priority = 'P2') as p2, count(*) filter (severity = 'high') as high, count(*) filter (source_type = 'import_alert') as import_alerts, count(*) filter (source_type = 'warning_letter') as warning_letters, count(*) filter (signal_direction = 'escalating') as escalating, count(*) filter (classification_status = 'confirmed') as confirmed from clus",
    "full",
)(U.insight_counts)

# ---- rules whose branches need texts that the tables lack: each row takes one by its number ----


def _by(k: int, *texts):
    out = F
    for i, t in enumerate(texts):
        out = out.when(F.col("rec_no") % k == i, t if not isinstance(t, str) else F.lit(t))
    return out


def _case(k: int, *texts: str) -> str:
    return "case " + " ".join(f"when rec_no % {k} = {i} then {t}" for i, t in enumerate(texts)) + " end"


on_citations("prj25_boilerplate", f"{O.CIT} select rec_no from raw where (length(lower(summary)) - length(replace(lower(summary), 'voluntary recall', ''))) // 16 + rec_no % 5 >= 3")(
    lambda c: c.where(E.is_boilerplate(F.concat("summary", F.expr("repeat('; Voluntary Recall', cast(rec_no % 5 as int))")))).select("rec_no")
)
on_citations(
    "prj29_redact",
    f"{O.CIT} select rec_no, {_case(4, 'summary', chr(39) + 'x [redacted] y' + chr(39), 'summary || ' + chr(39) + '[redacted][redacted]' + chr(39), chr(39) + 'a b (b)(x) c' + chr(39))} as text from raw",
)(lambda c: c.select("rec_no", D.redact(_by(4, F.col("summary"), "x (b)(4)  y", F.concat("summary", F.lit("(b)(4)(b)(16)")), "a   b \t (b)(x)\n\nc")).alias("text")))
_SNIP = ["'during our inspection: ' || summary || '.'", "'A violation of ' || summary", "'Dear ' || summary", "summary", "'You failed to act. Then more. ' || 'S1. S2. S3. S4. S5. S6.'"]
on_citations("prj28_snippet", f"{O.CIT} select rec_no, {_case(5, *_SNIP)} as snippet from raw")(
    lambda c: c.select(
        "rec_no",
        D.violation_snippet(
            _by(
                5,
                F.concat(F.lit("To the firm. We write during our inspection: "), "summary", F.lit(".")), F.concat(F.lit("Intro words here. A violation of "), "summary"), F.concat(F.lit("header Dear "), "summary"), F.col("summary"),
                "Head. You failed to act. Then more. S1. S2. S3. S4. S5. S6. S7. S8.",
            )
        ).alias("snippet"),
    )
)
_NAME_SQL = "case when company = '' then '' when contains(company, 'ENTITY') then replace(company, 'ENTITY', 'Entity') else company end"
on_citations("prj37_entity_names", f"{O.CIT} select rec_no, {_NAME_SQL} || {_case(3, chr(39) + ' of LLC Inc.' + chr(39), chr(39) + ' d/b/a the (GMP) Corp.' + chr(39), chr(39) + ' Mc-donald' + chr(39))} as name from raw")(
    lambda c: c.select("rec_no", D.entity_name(F.concat("company", _by(3, " OF llc inc", " D/B/A THE (gmp) CORP", " MC-DONALD"))).alias("name"))
)
on_citations(
    "flt12_fallback",
    f"""{O.CIT}, n as (select severity, count(*) filter (authority = 'MHRA' and source_type = 'recall') as a, count(*) filter (product_type = 'capsule' and source_type = 'food_enforcement') as b, count(*) as t from raw group by 1)
 select severity, case when b > 0 then 'rare' when a > 0 and severity = 'high' then 'recall' else 'all' end as choice, case when b > 0 then b when a > 0 and severity = 'high' then a else t end as n from n""",
)(lambda c: _fallbacks(c))


def _fallbacks(c: DataFrame) -> DataFrame:
    rare = (F.col("product_type") == "capsule") & (F.col("source_type") == "food_enforcement")
    recall = (F.col("authority") == "MHRA") & (F.col("source_type") == "recall") & (F.col("severity") == "high")
    out = None
    for level in ("high", "medium", "low"):
        one = T.first_nonempty(c.where(F.col("severity") == level), [("rare", rare), ("recall", recall), ("all", F.lit(True))]).select(F.lit(level).alias("severity"), "choice", "n")
        out = one if out is None else out.unionByName(one)
    return out


on_citations(
    "win06_collapse",
    f"{O.CLUST}, f as (select * from clus where severity <> 'high') select rec_no, n - 1 as other_members from (select *, row_number() over (partition by coalesce(cluster_id, id) order by not cluster_primary, rec_no) as k, count(*) over (partition by coalesce(cluster_id, id)) as n from f) where k = 1",
    "full",
)(lambda c: T.collapse(c.where("severity <> 'high'")).select("rec_no", "other_members"))
on_citations("win06_collapse_all", f"{O.CLUST} select rec_no, cluster_size - 1 as other_members from clus where cluster_primary", "full")(lambda c: T.collapse(c).select("rec_no", "other_members"))
on_citations(
    "udx02_stub_sentiment",
    f"{O.CIT} select rec_no, case when regexp_matches(lower(summary), 'recall|contamination|death|warning') then 'negative' else 'neutral' end as sentiment, substr(summary, 1, 60) as ai_summary from raw",
)(lambda c: E.sentiment_answers(E.ask(c, "rec_no", "summary"), "rec_no").select("rec_no", "sentiment", "ai_summary"))
_SUS = f"""{O.CLUST}, u as (select *, n_evidence = 0 as bare, classification_status = 'unconfirmed' as un, case when ({O._GUIDE} and primary_gmp_category not in ('Labelling & claims', 'Ingredient safety', 'Contamination & sterility')) or primary_gmp_category not in (select label from evir) then 0
  else (select count(*) from modr where label = failure_mode and contains(lower(best_text), phrase)) end as modes from clus)"""
on_citations("flt23_suspicion_level", f"{_SUS} select rec_no, case when not un and not bare then 'ok' when un or (bare and modes = 0) then 'suspicious' else 'weak' end as level from u", "full")(lambda c: D.suspicion(c).select("rec_no", "level"))
_TOLD = "case when rec_no % 5 = 0 then 'A Positive Signal for VMS, again' when rec_no % 5 = 1 then 'Please monitor for regulatory implications' else coalesce(ai_summary, '') end"
on_signals("flt24_generic_text", f"{O.SIG} select rec_no from s where {_TOLD} = '' or rec_no % 5 < 2")(
    lambda s: s.where(D.is_generic(F.when(F.col("rec_no") % 5 == 0, "A Positive Signal for VMS, again").when(F.col("rec_no") % 5 == 1, "Please monitor for regulatory implications").otherwise(F.col("ai_summary")))).select("rec_no")
)
on_signals("agg45_token_totals", f"{O.SIG} select authority, count(*) as calls, sum(len(string_split(title, ' ')))::bigint as input_tokens, sum(len(string_split(ai_summary, ' ')))::bigint as output_tokens from s where coalesce(ai_summary, '') <> '' group by 1")(
    lambda s: E.token_totals(s.where("coalesce(ai_summary, '') <> ''").select(F.col("authority").alias("phase"), F.size(F.split("title", " ")).alias("input_tokens"), F.size(F.split("ai_summary", " ")).alias("output_tokens"))).withColumnRenamed("phase", "authority")
)
on_signals("flt04_exists", f"{O.SIG} select rec_no from s where authority = 'tga' and url in (select url from s where authority = 'fda')")(lambda s: s.where("authority = 'tga'").join(s.where("authority = 'fda'").select("url").distinct(), "url", "left_semi").select("rec_no"))
