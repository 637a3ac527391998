"""Signal- and citation-shaped views derived from the test tables.

The view text reads the same in Spark SQL and DuckDB but for the hash function; ``{events}``
and its like name tables in Spark and are the registered views in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SIGNALS_AS_OF = "2024-01-31 00:00:00"
CITATIONS_AS_OF = "2001-08-01"

SIGNALS = """
select e.event_id as rec_no, substr({sha}(concat('ev::', cast(e.event_id as string)){bits}), 1, 16) as source_id,
  case e.event_id % 5 when 0 then 'tga' when 1 then 'fda' when 2 then 'artg' when 3 then 'pubmed' else 'adverse_events' end as authority,
  case when e.event_id % 53 = 0 then ' Unknown ' when e.event_id % 59 = 0 then '' when e.event_id % 7 = 0 then upper(p.p_name) else p.p_name end as ingredient_name,
  e.ts as scraped_at,
  concat('https://example.test/', cast(e.event_id % 601 as string)) as url,
  concat(p.p_name, ' ', e.event_type, ' notice') as title,
  case e.event_type when 'error' then 'safety_alert' when 'click' then 'warning' when 'purchase' then 'new_listing' when 'signup' then 'recall' else 'other' end as event_type,
  case when e.value > 150 then 'high' when e.value > 75 then 'medium' when e.event_id % 11 = 0 then 'unrated' else 'low' end as severity,
  case when e.ts >= timestamp '2024-01-17 00:00:00' and e.user_id % 40 < 6 then 'negative'
       when e.event_type in ('error','click') then 'negative' when e.event_type in ('purchase','signup') then 'positive'
       when e.event_id % 13 = 0 then '' else 'neutral' end as sentiment,
  case when e.event_id % 17 = 0 then null else cast(e.event_id % 101 as double) / 100 end as sentiment_confidence,
  case when e.ts >= timestamp '2024-01-16 00:00:00' and e.user_id % 40 < 10 then 'safety_concern'
       when e.event_id % 3 = 0 then 'other' else 'efficacy_claim' end as signal_type,
  case when e.user_id % 7 = 0 then 'high' else 'low' end as market_significance,
  case when e.user_id % 4 = 0 then 'yes' else 'no' end as competitor_signal,
  case when e.event_id % 6 = 0 then null when e.event_id % 10 = 1 then '' else concat('summary ', cast(e.event_id as string)) end as ai_summary
from {events} e join {part} p on p.p_partkey =
  case when e.ts >= timestamp '2024-01-24 00:00:00' and e.event_id % 3 = 0 then 100 + e.user_id % 10 else e.user_id % 40 end
"""

CITATIONS = """
select o.o_orderkey as rec_no, substr(md5(concat('ci::', cast(o.o_orderkey as string))), 1, 12) as id,
  case when o.o_custkey % 3 = 0 then concat('Solo ', cast(o.o_custkey as string)) when o.o_orderkey % 29 = 0 then '' when o.o_orderkey % 5 = 0 then concat(' ENTITY ', cast(o.o_custkey % 40 as string), ' ') else concat('Entity ', cast(o.o_custkey % 40 as string)) end as company,
  case o.o_custkey % 5 when 0 then 'FDA' when 1 then 'FDA' when 2 then 'TGA' when 3 then 'EFSA' else 'MHRA' end as authority,
  case when o.o_orderkey % 23 = 0 then 'inspection_finding' else case (o.o_custkey % 40) % 8 when 0 then 'warning_letter' when 1 then 'drug_enforcement' when 2 then 'device_enforcement' when 3 then 'recall' when 4 then 'import_alert' when 5 then 'safety_alert' when 6 then 'compliance_action' else 'scientific_opinion' end end as source_type,
  case when o.o_orderkey % 97 = 0 then null else cast(o.o_orderdate as date) end as date,
  case c.c_mktsegment when 'FURNITURE' then 'Supplement / Nutraceutical' when 'MACHINERY' then 'CMO' else 'General Pharma' end as facility_type,
  case o.o_orderpriority when '1-URGENT' then 'high' when '5-LOW' then 'low' else 'medium' end as severity,
  concat('https://example.test/', case when o.o_orderkey % 31 = 0 then 'guidance/' else 'notices/' end, cast(o.o_orderkey as string), case when o.o_orderkey % 7 = 0 then concat('?RecallNumber=Z-', cast(o.o_orderkey % 900 as string)) else '' end) as url,
  case when o.o_orderkey % 4 = 0 then 'capsule' when o.o_orderkey % 4 = 1 then '' else 'tablet' end as product_type,
  case when o.o_orderkey % 6 = 0 then 'success' when o.o_orderkey % 6 = 1 then 'cached' when o.o_orderkey % 6 = 2 then 'failed' else '' end as enrichment_status,
  case when o.o_orderkey % 6 in (0, 1) then concat('Inspection of equipment and calibration found deviation; ', case when o.o_orderkey % 12 < 6 then repeat('quality system and training records were reviewed. ', 6) else 'short' end) else '' end as enriched_text,
  case when o.o_orderkey % 9 = 0 then 'stated violation of cgmp and batch record' else '' end as violation_details,
  case when o.o_orderkey % 10 < 3 then 0.8 when o.o_orderkey % 10 < 6 then 0.5 else 0.0 end as classification_confidence,
  case when o.o_orderkey % 10 < 2 then 'review the batch' else '' end as decision_summary,
  case ((o.o_custkey % 40) * 3 + o.o_orderkey % 3) % 26
    when 0 then 'Sterility failure found in aseptic fill'
    when 1 then 'microbial contamination with salmonella'
    when 2 then 'nitrosamine impurity above limit, heavy metal'
    when 3 then 'foreign material and glass particle in vial'
    when 4 then 'oos result, failed testing, potency low'
    when 5 then 'stability data missing, shelf life not supported'
    when 6 then 'data integrity and audit trail deficiency'
    when 7 then 'calibration overdue, unqualified equipment'
    when 8 then 'cleaning validation incomplete, equipment cleaning'
    when 9 then 'supplier qualification missing, fsvp'
    when 10 then 'out of specification batch failure'
    when 11 then 'process validation absent, unvalidated process'
    when 12 then 'misleading label with unapproved claim'
    when 13 then 'import alert, detention without examination'
    when 14 then 'voluntary recall, market withdrawal'
    when 15 then 'class i recall, urgent recall'
    when 16 then 'class ii recall of one lot'
    when 17 then 'serious adverse event and death reported'
    when 18 then 'pest control and sanitation failure'
    when 19 then 'tobacco product warning under tobacco control act'
    when 20 then 'deviation and capa investigation open'
    when 21 then 'training and competency records'
    when 22 then 'csv software validation'
    when 23 then 'short note'
    when 24 then 'undeclared drug sildenafil'
    else 'benzene and ndma found, automatic detention of tobacco product' end as summary
from {orders} o join {customer} c on c.c_custkey = o.o_custkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SIGNALS.replace("{sha}", "sha2").replace("{bits}", ", 256")
    return spark.sql(text, **tables(spark, sf_dir, "events", "part"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CITATIONS, **tables(spark, sf_dir, "orders", "customer"))


def signals_sql() -> str:
    text = SIGNALS.replace("{sha}", "sha256").replace("{bits}", "")
    return text.replace("{events}", "events").replace("{part}", "part")


def citations_sql() -> str:
    return CITATIONS.replace("{orders}", "orders").replace("{customer}", "customer")
