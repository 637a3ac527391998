"""Queries of reports, sinks, incremental tables and phrase search, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import audit as U
from ..operators import display as D
from ..operators import enrich as E
from ..operators.answers import AnswerBook, instructions, prompts_of, within_budget
from ..operators.store import accuracy, shared_path
from ..operators.versioned import CitationStore, FeedbackLog, KeyedTable
from ..sources.archives import adverse_event_files
from ..streaming.tables import apply_batch
from . import oracle as O
from .catalog import QUERIES, SQL, on_citations
from .views import CITATIONS_AS_OF, signals, tables

B = "::bigint"


def _blank(x: str) -> str:
    return f"coalesce({x}, '') = ''"


def _counts(section: str, column: str, limit: str = "") -> str:
    return f"(select '{section}' as section, {column} as label, count(*) as n, '' as detail from c where not {_blank(column)} group by 2 order by 3 desc, 2 {limit})"


def _figures(section: str, figures: dict[str, str], source: str = "c") -> str:
    return " union all ".join(f"select '{section}', '{k}', {v}{B}, '' from {source}" for k, v in figures.items())


_MISSING = " or ".join(_blank(x) for x in U.REQUIRED)
SNK10 = f"""{O.CLUST}, c as (select *, decision_summary as ai_summary, classification_confidence as ai_confidence, violation_details as recommended_action, coalesce(failure_mode, '') as mode from clus),
 g as (select cluster_id, count(*) as n, count(*) filter (priority = 'P1') as p1, count(*) filter (priority = 'P2') as p2, max(cluster_label) filter (cluster_primary) as label, max(authority) filter (cluster_primary) as authority,
   max(source_type) filter (cluster_primary) as type, max(mode) filter (cluster_primary) as mode, max(coalesce(cluster_priority, priority, '')) filter (cluster_primary) as priority,
   case when count(date) >= 2 then strftime(min(date), '%Y-%m-%d') || '–' || strftime(max(date), '%Y-%m-%d') else coalesce(strftime(min(date), '%Y-%m-%d'), '') end as span from c where cluster_id is not null and cluster_size > 1 group by 1)
select 'total' as section, 'total_citations' as label, count(*) as n, '' as detail from c
union all {_figures('enrichment', {s: f"count(*) filter (enrichment_status = '{s}')" for s in U.STATUSES})}
union all {_figures('ai_pass', {'total_with_ai': f"count(*) filter (not {_blank('ai_summary')})", 'confidence_high': 'count(*) filter (ai_confidence >= 0.7)', 'confidence_low': f"(count(*) filter (not {_blank('ai_summary')}) - count(*) filter (ai_confidence >= 0.7))"})}
union all {_figures('data_quality', {
    'missing_required_intelligence_fields_count': f'count(*) filter ({_MISSING})', 'raw_listing_summary_populated': f"count(*) filter (not {_blank('raw_listing_summary')})", 'raw_listing_summary_blank': f"count(*) filter ({_blank('raw_listing_summary')})",
    'decision_summary_populated_count': f"count(*) filter (not {_blank('decision_summary')})", 'recommended_action_populated_count': f"count(*) filter (not {_blank('recommended_action')})", 'ai_results_accepted_count': 'max(7)', 'ai_results_discarded_low_confidence_count': 'max(2)'})}
union all {_figures('clustering', {'total_clusters': 'count(*)', 'multi_record_clusters': 'count(*)', 'grouped_records_count': 'coalesce(sum(n), 0)', 'p1_clusters': 'count(*) filter (p1 > 0)', 'p2_clusters': 'count(*) filter (p2 > 0 and p1 = 0)'}, 'g')}
union all {_counts('priority_breakdown', 'priority')} union all {_counts('top_categories', 'primary_gmp_category', 'limit 10')} union all {_counts('top_failure_modes', 'failure_mode', 'limit 5')} union all {_counts('regulatory_pressure', 'regulatory_pressure')}
union all (select 'p1p2_clusters', concat_ws('|', entity, authority, source_type, mode), count(*), count(*) filter (priority = 'P1') || '|' || count(*) filter (priority = 'P2') from c where priority in ('P1', 'P2') group by entity, authority, source_type, mode having count(*) >= 2
  order by count(*) desc, entity, authority, source_type, mode limit 20)
union all (select 'top_10_clusters', cluster_id, n, concat_ws('|', label, authority, type, mode, priority, span, p1, p2) from g order by n desc, cluster_id limit 10)
union all select * from (values ('ai_call_tracking', 'accepted', 7, ''), ('ai_call_tracking', 'discarded', 2, ''), ('sample', 'rows', 3, ''), ('failed_sources', 'tga', 1, ''))
"""


@on_citations("snk10_audit", SNK10, "full")
def _(c):
    c = c.withColumns({"ai_summary": F.col("decision_summary"), "ai_confidence": F.col("classification_confidence"), "recommended_action": F.col("violation_details")})
    return U.audit_lines(U.enrichment_audit(c, CITATIONS_AS_OF, ["tga"], {"accepted": 7, "discarded": 2}, {"rows": 3}))


# ---- phrase search -----------------------------------------------------------------------

_TERMS = "[" + ", ".join(map(O.quoted, R.KNOWN_INGREDIENTS)) + "]"
QUERIES["prj39_title_ingredient"] = lambda spark, d: tables(spark, d, "documents")["documents"].select("doc_id", D.title_ingredient(F.col("text")).alias("ingredient"))
SQL["prj39_title_ingredient"] = f"select doc_id, list_filter({_TERMS}, lambda x: contains(lower(text), x))[1] as ingredient from documents"

on_citations(
    "msc03_evidence_terms",
    f"""{O.CLUST}, e as (select label, list(phrase) as phrases, list(phrase order by rowid) as o from (select *, row_number() over () as rowid from evir) group by 1),
 x as (select rec_no, list_filter(coalesce(o, []), lambda p: contains(lower(concat_ws(' ', nullif(violation_details, ''), nullif(raw_listing_summary, ''), nullif(summary, ''), nullif(enriched_text, ''))), p)) as terms,
  len(list_filter(coalesce(o, []), lambda p: contains(lower(coalesce(enriched_text, '')), p))) > 0 as enriched from clus left join e on label = primary_gmp_category) select rec_no, array_to_string(terms, '|') as terms, enriched from x""",
    "full",
)(lambda c: D.evidence_terms(c).select("rec_no", F.array_join("terms", "|").alias("terms"), "enriched"))


def _any(text: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {O.quoted(x)})" for x in terms) + ")"


_OWN = "(select bool_or({0}) from {1} where label = {2} and contains(lower(best_text), phrase))"
on_citations(
    "msc05_equipment_trace",
    f"""{O.CLUST}, e as (select *, coalesce({_OWN.format(_any('phrase', R.EQUIPMENT_TERMS), 'evir', 'primary_gmp_category')}, false) and n_evidence > 0 as a, coalesce({_OWN.format(_any('phrase', R.EQUIPMENT_TERMS), 'modr', 'failure_mode')}, false) and not ({O._GUIDE} and primary_gmp_category not in ('Labelling & claims', 'Ingredient safety', 'Contamination & sterility')) as b,
  primary_gmp_category in {O.in_list(R.EQUIPMENT_CATEGORIES)} as p, failure_mode in {O.in_list(R.EQUIPMENT_MODES)} as m from clus)
 select rec_no, a or b as has_evidence, {_any("lower(coalesce(summary, ''))", R.NOISE)} as low_value,
  case when not p and not m then 'UNKNOWN — should not appear here' else concat_ws('; ', case when p then 'primary_gmp_category=''' || primary_gmp_category || '''' end, case when m then 'failure_mode=''' || failure_mode || '''' end) end as reason from e""",
    "full",
)(lambda c: D.equipment_trace(c).select("rec_no", "has_evidence", "low_value", "reason"))


# ---- incremental tables and committed sinks -----------------------------------------------


def _incremental(spark, d):
    """Four batches of signals through the keyed table; blank summaries are filled as they come in."""
    s = signals(spark, d).select("source_id", "rec_no", "ai_summary")
    table = KeyedTable(spark, shared_path(spark, "signals-by-key"), s.schema, "source_id", buckets=16)
    answer = lambda rows: rows.select("source_id", F.concat(F.lit("told "), F.substring("source_id", 1, 4)).alias("ai_summary"))
    for i in range(4):
        # neighbouring batches share rows, of which the table keeps the first
        apply_batch(table, s.where(F.pmod("rec_no", F.lit(4)).isin(i, (i + 1) % 4)), f"batch-{i}", "ai_summary", answer)
    return table.read()


QUERIES["str03_incremental"] = _incremental
SQL["str03_incremental"] = f"{O.SIG} select source_id, rec_no, case when coalesce(ai_summary, '') = '' then 'told ' || substr(source_id, 1, 4) else ai_summary end as ai_summary from s"


def _feedback(spark, d):
    """Ratings of signals through the log in two steps, one of them twice; the table against its mirror."""
    kinds = "case rec_no % 4 when 0 then 'correct' when 1 then 'incorrect' when 2 then 'partially_correct' else 'skipped' end"
    rows = signals(spark, d).selectExpr("source_id", f"{kinds} as rating", "rec_no")
    schema = "source_id string, rating string, rec_no long"
    log = FeedbackLog(spark, shared_path(spark, "feedback"))
    for step in (0, 1, 1):
        log.feedback(str(step), rows.where(F.col("rec_no") % 2 == step))
    log.accuracy("0", accuracy(log.table(schema)), "2024-01-31")
    both = log.table(schema).groupBy("rating").agg(F.count("*").alias("n"), F.sum("rec_no").alias("sum_no")).join(log.mirror(schema).groupBy("rating").agg(F.count("*").alias("mirrored")), "rating")
    return both.crossJoin(F.broadcast(log.figures().select("total", "pct")))  # one row


QUERIES["snk05_06_feedback_log"] = _feedback
SQL["snk05_06_feedback_log"] = f"""{O.SIG}, r as (select case rec_no % 4 when 0 then 'correct' when 1 then 'incorrect' when 2 then 'partially_correct' else 'skipped' end as rating, rec_no from s)
select rating, count(*) as n, sum(rec_no){B} as sum_no, count(*) as mirrored, (select count(*) from r) as total, (select round(100.0::double * count(*) filter (rating = 'correct') / count(*), 1) from r) as pct from r group by 1"""


@on_citations("snk08_citation_store", f"{O.CLUST} select authority, count(*) as n, count(distinct id) as ids, min(rec_no) as first_no from clus group by 1", "full")
def _(c):
    store = CitationStore(c.sparkSession, shared_path(c.sparkSession, "citation-store"))
    names = ["id", "rec_no", "authority", "source_type", "priority", "date", "summary"]
    store.publish("run", c.select(*names), "<script>const DATA = @DATA@;</script>", "@DATA@")
    kind = c.select(*names).schema
    back = c.sparkSession.read.schema(kind).json(store.newest("partitioned"))
    flat = c.sparkSession.read.schema(kind).json(store.newest("flat")).groupBy("authority").agg(F.count_distinct("id").alias("ids"))
    return back.groupBy("authority").agg(F.count("*").alias("n"), F.min("rec_no").alias("first_no")).join(flat, "authority")


# ---- archives ------------------------------------------------------------------------------


def _zips(parts):
    """Sixty parts an archive: a note, then two CSV members under changing column names."""
    import io
    import zipfile

    def pack(key, rows):
        import pandas as pd

        rows = rows.sort_values("p_partkey")
        names = [("PRODUCT", "REACTIONS"), ("product_name", "event_type"), ("Product", "AE_TYPE")][key[0] % 3]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("note.txt", "nothing here")
            z.writestr("data/events.CSV", rows[["p_name", "p_type"]].to_csv(index=False, header=names))
            z.writestr("later.csv", "PRODUCT\nblue later\n")
        return pd.DataFrame({"url": [f"https://example.test/{key[0]}.zip"], "body": [out.getvalue()]})

    return parts.withColumn("g", F.expr("cast(p_partkey div 60 as int)")).groupBy("g").applyInPandas(pack, "url string, body binary")


def _adverse_events(spark, d):
    part = tables(spark, d, "part")["part"]
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return adverse_event_files(_zips(part.select("p_partkey", "p_name", "p_type")), "caers", ["blue", "brass", "steel"], now).select("source_id", "url", "title", F.element_at(F.split("body_text", "\n"), 3).alias("reaction_line"))


QUERIES["src10_zip_csv"] = _adverse_events
SQL["src10_zip_csv"] = """
with a as (select 'https://example.test/' || (p_partkey // 60) || '.zip' as url, p_name, p_type, row_number() over (partition by p_partkey // 60 order by p_partkey) - 1 as i from part),
 f as (select *, lower(p_name || ' ' || p_type) as low from a where i < 20),
 k as (select *, row_number() over (partition by url order by i) as k from f where contains(low, 'blue') or contains(low, 'brass') or contains(low, 'steel'))
select substr(sha256('adverse_events::' || url || '::' || trim(p_name) || '::' || i), 1, 16) as source_id, url, 'Adverse Event: ' || substr(trim(p_name), 1, 100) as title, 'Adverse Event / Reactions: ' || trim(p_type) as reaction_line from k where k <= 10
"""


# ---- model answers -------------------------------------------------------------------------

_ASKED = {"sentiment": "Rate the mood.", "brief": "Write a brief.", "claim": "Name the claim."}


def _answered(c):
    book = AnswerBook(c.sparkSession, shared_path(c.sparkSession, "answers"), buckets=16)
    variants = instructions(_ASKED, "summary", "violation_details")
    half = prompts_of(c.where(F.col("rec_no") % 2 == 0), variants)
    book.learn(half)
    book.learn(prompts_of(c, variants))  # the first half is known by now
    got = book.answers(c, "rec_no", variants)
    return E.sentiment_answers(got.withColumn("key", F.struct("rec_no", "variant")), "key").select("key.*", "sentiment", "sentiment_confidence", "ai_summary")


_ASK = ", ".join(f"({O.quoted(v)}, {O.quoted(t)})" for v, t in _ASKED.items())
on_citations(
    "udx01_answers",
    f"""{O.CIT}, p as (select rec_no, v as variant, concat_ws(chr(10), t, nullif(trim(summary), ''), nullif(trim(violation_details), '')) as prompt from raw, (values {_ASK}) x(v, t))
 select rec_no, variant, case when regexp_matches(lower(prompt), 'recall|contamination|death|warning') then 'negative' else 'neutral' end as sentiment, least(1.0::double, length(prompt)::double / 100) as sentiment_confidence, substr(prompt, 1, 60) as ai_summary from p""",
)(_answered)
on_citations("udx03_budget", f"{O.CIT} select rec_no, rank() over (order by tier, id)::bigint as place from (select *, case severity when 'high' then 1 when 'medium' then 2 else 3 end as tier from raw) qualify row_number() over (order by tier, id) <= 400")(
    lambda c: within_budget(c.withColumn("tier", F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)), 400, most=50).select("rec_no", F.rank().over(Window.orderBy("tier", "id")).cast("long").alias("place"))
)
