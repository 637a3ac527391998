"""DuckDB statements of the definitions, written apart from the Spark operators.

They share the fixed rule tables and the derived views, and nothing else.
"""

from __future__ import annotations

from ..functions import rules as R
from .views import CITATIONS_AS_OF, SIGNALS_AS_OF, citations_sql, signals_sql


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rules, name: str) -> str:
    """A (ord, label, size, phrase) table of ordered phrase rules."""
    rows = ", ".join(f"({i}, {quoted(label)}, {len(p)}, {quoted(x)})" for i, (label, p) in enumerate(rules) for x in p)
    return f"{name}(ord, label, size, phrase) as (values {rows})"


def in_list(xs) -> str:
    return "(" + ", ".join(map(quoted, xs)) + ")"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {quoted(pattern)}, 'is')"


def class_one(col: str) -> str:
    """class i not followed by class ii anywhere later, without look-ahead."""
    return f"regexp_matches(regexp_replace(lower({col}), '^.*class.?ii', '', 's'), 'class.?i\\b', 's')"


SIG = f"with sig as ({signals_sql()}), s as (select *, nullif(nullif(lower(trim(ingredient_name)), ''), 'unknown') as ing from sig)"
S30 = f"scraped_at >= timestamp '{SIGNALS_AS_OF}' - interval 30 day"
S14 = f"scraped_at >= timestamp '{SIGNALS_AS_OF}' - interval 14 day"
S7 = f"scraped_at >= timestamp '{SIGNALS_AS_OF}' - interval 7 day"

ROLLING = f"{SIG}, rolling as (select ing as ingredient, count(*) filter ({S7}) as count_7d, count(*) as count_30d from s where ing is not null and {S30} group by ing)"
SPIKES = f"{ROLLING}, spikes as (select *, count_7d * 30.0::double / (count_30d * 7.0::double) as spike_ratio from rolling where count_30d >= 2 and count_7d * 30 > 2 * 7 * count_30d)"
SENTIMENT = f"""{SIG}, w as (select ing as ingredient, case sentiment when 'positive' then 1 when 'negative' then -1 else 0 end as v,
  case when coalesce(sentiment_confidence, 0) = 0 then 0.5::double else sentiment_confidence end as c, {S14} as late from s where ing is not null and coalesce(sentiment, '') <> '' and {S30}),
 g as (select ingredient, count(*) as n, sum(v * c) / sum(c) as score_30d, sum(v * c) filter (late) / sum(c) filter (late) as a, sum(v * c) filter (not late) / sum(c) filter (not late) as b from w group by 1 having count(*) >= 2),
 sentiments as (select ingredient, n, score_30d, coalesce(a, score_30d) as score_14d, coalesce(b, score_30d) as score_prior, coalesce(a, score_30d) - coalesce(b, score_30d) as shift from g)"""
SHIFT = f"""{SIG}, r as (select ing, coalesce(nullif(signal_type, ''), nullif(event_type, ''), 'other') as type, row_number() over (order by scraped_at, rec_no) - 1 as pos, count(*) over () as total from s where {S30}),
 t as (select ing, pos >= total // 2 as late, type, count(*) as n, min(pos) as first from r where ing is not null group by all),
 d as (select *, row_number() over (partition by ing, late order by n desc, first) as k, sum(n) over (partition by ing) as total from t),
 shifts as (select f.ing as ingredient, f.type as from_type, l.type as to_type, f.n as from_n, l.n as to_n, cast(f.total as bigint) as total from d f join d l on f.ing = l.ing and f.k = 1 and l.k = 1 and not f.late and l.late
  where f.total >= 3 and f.type <> l.type and ((l.type = 'safety_concern' and f.type in ('efficacy_claim', 'other')) or (f.n >= 2 and l.n >= 2)))"""


def day(n: int) -> str:
    return f"(date '{CITATIONS_AS_OF}' - interval {n} day)"


_TITLE = "(coalesce(summary, '') || ' ' || coalesce(violation_details, ''))"
_GUIDE = f"(({rx('coalesce(url, chr(32))', R.GUIDANCE_URL)} or {rx(_TITLE, R.GUIDANCE_TITLE)}) and not {rx(_TITLE, R.ENFORCEMENT_SIGNAL)})"
_FIX = f"case when source_type <> 'inspection_finding' then source_type when authority in ('EFSA', 'BfR') then 'scientific_opinion' when authority = 'MHRA' and contains(url, '/guidance/') then 'guidance' when {_GUIDE} then 'guidance' else source_type end"
_TYPES = ("warning_letter", "drug_enforcement", "device_enforcement", "food_enforcement", "recall", "import_alert")
_EVIDENCE = [(k, v) for k, v in R.EVIDENCE.items()]

CIT = f"with {values(R.CATEGORY, 'catr')}, {values(R.FAILURE_MODE, 'modr')}, {values(_EVIDENCE, 'evir')}, {values(R.FACILITY, 'facr')}, raw as ({citations_sql()})"
FIXED = f"{CIT}, fixed as (select * replace ({_FIX} as source_type) from raw)"
TEXTS = f"""{FIXED}, t0 as (select *, substr(coalesce(nullif(summary, ''), nullif(violation_details, ''), ''), 1, 500) as raw_listing_summary from fixed),
 t as (select *, case when enrichment_status in ('success', 'cached') and length(enriched_text) > 250 then enriched_text else coalesce(nullif(raw_listing_summary, ''), nullif(violation_details, ''), summary, '') end as best_text,
  concat_ws(' ', nullif(raw_listing_summary, ''), nullif(summary, ''), nullif(violation_details, ''), nullif(enriched_text, '')) as context_text,
  coalesce(summary, '') || ' ' || coalesce(violation_details, '') || ' ' || coalesce(enriched_text, '') as severity_text from t0)"""
CATS = f"""{TEXTS}, ch as (select rec_no, label, row_number() over (partition by rec_no order by n desc, ord) as k from (select rec_no, label, ord, count(*) as n from t, catr where contains(lower(best_text), phrase) group by all)),
 cg as (select rec_no, max(label) filter (k = 1) as p, list(label order by k) filter (k between 2 and 4) as sec from ch group by 1),
 cats as (select t.*, coalesce(p, '{R.NO_DETAIL}') as primary_gmp_category, coalesce(sec, []::varchar[]) as secondary_gmp_categories from t left join cg using (rec_no))"""
MODES = f"""{CATS}, mh as (select rec_no, ord, label, size, count(*) as n from t, modr where contains(lower(best_text), phrase) and (label <> 'contamination_chemical' or contains(phrase, ' ')) group by all
   union all select rec_no, 1, 'contamination_chemical', {len(R.FAILURE_MODE[1][1])}, 1 from t where {rx('best_text', R.CHEMICAL)}),
 ms as (select rec_no, ord, label, least(1.0::double, sum(n) / greatest(max(size) * 0.3::double, 1.0::double)) as score from mh group by all),
 mb as (select rec_no, label, score from ms qualify row_number() over (partition by rec_no order by score desc, ord) = 1),
 modes as (select c.*, case when {rx('context_text', R.TOBACCO)} and not {rx('context_text', R.PHARMA_SAFETY)} then 'insufficient_detail' else coalesce(mb.label, '') end as failure_mode,
   case when {rx('context_text', R.TOBACCO)} and not {rx('context_text', R.PHARMA_SAFETY)} then 0.1::double else coalesce(mb.score, 0.0::double) end as failure_mode_confidence from cats c left join mb using (rec_no))"""
_RICH = "(enrichment_status in ('success', 'cached') and length(coalesce(enriched_text, '')) > 100)"
EVIDENCE = f"""{MODES}, el as (select label, max(size) as size, list(phrase order by phrase) as phrases from evir group by 1),
 ev0 as (select m.*, case when {_GUIDE} and primary_gmp_category not in ('Labelling & claims', 'Ingredient safety', 'Contamination & sterility') then null else el.phrases end as terms, el.size as nt from modes m left join el on el.label = m.primary_gmp_category),
 ev1 as (select *, len(list_filter(terms, lambda x: contains(lower(best_text), x))) as na, len(list_filter(terms, lambda x: contains(lower(concat_ws(' ', nullif(raw_listing_summary, ''), nullif(violation_details, ''), nullif(summary, ''))), x))) as nl,
   case when {_RICH} then len(list_filter(terms, lambda x: contains(lower(enriched_text), x))) else 0 end as ne from ev0),
 evid as (select * exclude (terms, nt, na, nl, ne), case when terms is null then 0.0::double else least(1.0::double, na / greatest(nt * 0.25::double, 1.0::double)) end as category_confidence,
   case when terms is null then 'unconfirmed' when ne > 0 then 'confirmed' when nl > 0 and least(1.0::double, na / greatest(nt * 0.25::double, 1.0::double)) >= 0.3 then 'provisional' when na > 0 then 'provisional' else 'unconfirmed' end as classification_status,
   case when terms is null then 0 else least(na, 10) end as n_evidence,
   case when {_RICH} then 'enriched_text' when raw_listing_summary <> '' then 'raw_listing_summary' when coalesce(violation_details, '') <> '' then 'violation_details' when coalesce(summary, '') <> '' then 'summary' else 'unknown' end as classification_basis from ev1)"""
_L = "lower(severity_text)"
_CRIT = f"({rx('severity_text', R.CRITICAL)} or {class_one('severity_text')})"
_ONE = f"(contains({_L}, 'class i') and not contains({_L}, 'class ii'))"
PRIO = f"""{EVIDENCE}, p1 as (select *, case when source_type = 'warning_letter' then if({_CRIT}, 'critical', 'high')
   when source_type in {in_list(R.ENFORCEMENT)} then if({_ONE}, 'critical', if(contains({_L}, 'class ii'), 'high', 'medium'))
   when source_type = 'import_alert' then if(contains({_L}, 'automatic detention'), 'high', 'medium')
   when source_type = 'recall' then if({_CRIT} or {_ONE}, 'critical', if(contains({_L}, 'class ii'), 'high', 'medium'))
   when source_type = 'safety_alert' then if(contains({_L}, 'urgent') or contains({_L}, 'immediate') or contains({_L}, 'serious'), 'high', 'medium')
   else coalesce(nullif(severity, ''), 'medium') end as regulatory_severity,
  primary_gmp_category in ('{R.NO_DETAIL}', '') and failure_mode in ('insufficient_detail', '') as low_detail from evid),
 p2 as (select *, case when {rx("(coalesce(company, '') || ' ' || facility_type)", R.CONTRACT)} then case regulatory_severity when 'low' then 'medium' when 'medium' then 'high' else 'critical' end else regulatory_severity end as operational_severity,
  case when source_type = 'warning_letter' then 'immediate' when source_type in ('import_alert', 'inspection_finding', 'compliance_action') then 'elevated' else 'standard' end as inspection_risk,
  case when authority in ('TGA', 'MHRA', 'BfR') then 'direct' when authority = 'EFSA' then 'reference' when facility_type = 'Supplement / Nutraceutical' then 'indirect' else 'reference' end as market_relevance_au from p1),
 prio as (select *, case when (failure_mode in {in_list(R.HIGH_RISK_MODES)} and failure_mode_confidence >= 0.7 and not (failure_mode = 'recall_mandatory' and source_type = 'warning_letter' and not {rx('severity_text', R.PHARMA_SAFETY)}))
    or (regulatory_severity = 'critical' and source_type in ('recall', 'drug_enforcement', 'device_enforcement', 'food_enforcement')) then 'P1'
   when operational_severity in ('high', 'critical') and market_relevance_au in ('direct', 'indirect') and not low_detail then 'P1'
   when regulatory_severity = 'critical' or (regulatory_severity = 'high' and not low_detail) then 'P2'
   when (low_detail and (regulatory_severity = 'high' or inspection_risk = 'immediate')) or (regulatory_severity = 'medium' and not low_detail) then 'P3' else 'P4' end as priority from p2)"""
RECUR = f"""{PRIO}, r0 as (select *, nullif(lower(trim(company)), '') as co from prio), win as (select * from r0 where date >= {day(90)}),
 rc as (select co, count(*) as n from win where co is not null group by 1), rp as (select primary_gmp_category, count(*) as n, count(*) filter (date >= {day(45)}) as now from win group by 1), rm as (select failure_mode, count(*) as n from win where failure_mode <> '' group by 1),
 rec as (select r0.* replace (case when coalesce(rc.n, 0) - 1 >= 2 and regulatory_severity = 'high' and priority in ('P2', 'P3') then 'P1' else priority end as priority),
   greatest(coalesce(rc.n, 0) - 1, 0)::bigint as recurrence_count_company_90d, greatest(coalesce(rp.n, 0) - 1, 0)::bigint as recurrence_count_category_90d, greatest(coalesce(rm.n, 0) - 1, 0)::bigint as recurrence_count_failure_mode_90d,
   case when coalesce(rc.n, 0) >= 2 then 'escalating' when r0.co is not null and r0.date < {day(60)} then 'resolving' else 'holding' end as signal_direction,
   case when coalesce(rp.n - rp.now, 0) = 0 then 'stable' when rp.now * 10 > 13 * (rp.n - rp.now) then 'increasing' when rp.now * 10 < 7 * (rp.n - rp.now) then 'decreasing' else 'stable' end as regulatory_pressure
  from r0 left join rc on rc.co = r0.co left join rp on rp.primary_gmp_category = r0.primary_gmp_category left join rm on rm.failure_mode = r0.failure_mode)"""
_SAFE = rx("context_text", R.LOW_DETAIL_SAFETY)
CAPS = f"""{RECUR}, cap1 as (select * replace (case when priority in ('P1', 'P2') and failure_mode = 'insufficient_detail' and failure_mode_confidence <= 0.1 and not (classification_confidence >= 0.5 and coalesce(decision_summary, '') <> '')
   and not {_SAFE} and not (source_type in ('recall', 'drug_enforcement', 'device_enforcement', 'food_enforcement') and operational_severity in ('high', 'critical')) and not (market_relevance_au = 'direct' and regulatory_severity = 'high') then 'P3' else priority end as priority) from rec),
 cap2 as (select * replace (case when priority not in ('P1', 'P2') or {_SAFE} then priority when source_type in {in_list(R.NOT_ENFORCEMENT)} then 'P4' when classification_status = 'unconfirmed' and source_type not in {in_list(_TYPES)} then 'P3' else priority end as priority) from cap1)"""
_ENT = "coalesce(nullif(company, ''), nullif(product_type, ''), 'Unknown entity — ' || authority || ' ' || source_type)"
CLUST = f"""{CAPS}, k0 as (select *, {_ENT} as entity, case when source_type = 'import_alert' or date is null then id when source_type = 'warning_letter' then strftime(date, '%Y-%m') || if(day(date) <= 14, '-E', '-L') else strftime(date, '%Y-%m') end as bucket from cap2),
 k1 as (select *, trim(lower(entity)) || '|' || lower(authority) || '|' || lower(source_type) || '|' || lower(failure_mode) || '|' || bucket as ckey from k0),
 k2 as (select *, count(*) over (partition by ckey) as cluster_size, row_number() over (partition by ckey order by priority, if(classification_confidence >= 0.5 and decision_summary <> '', 0, 1), coalesce(strftime(date, '%Y%m%d')::int, 0) desc, id) as rk,
   min(priority) over (partition by ckey) as best, min(strftime(date, '%Y-%m')) over (partition by ckey) as lo, max(strftime(date, '%Y-%m')) over (partition by ckey) as hi, count(date) over (partition by ckey) as nd from k1),
 clus as (select * exclude (rk, best, lo, hi, nd, bucket), if(cluster_size > 1, substr(sha256(ckey), 1, 12), null) as cluster_id, rk = 1 as cluster_primary, if(cluster_size > 1, best, null) as cluster_priority,
   case when cluster_size = 1 then null when nd >= 2 then cluster_size || ' records, ' || lo || '–' || hi when nd = 1 then cluster_size || ' records, ' || lo else cluster_size || ' records' end as cluster_reason,
   case when cluster_size > 1 then substr(first_value(entity) over (partition by ckey order by rk) || case when failure_mode in ('', 'insufficient_detail') then '' else ' — ' || replace(failure_mode, '_', ' ') end, 1, 120) end as cluster_label from k2)"""
