"""Audit reports: all distributions of a citation table from one scan by grouping sets.

Every section of a report is one grouping set.  One Expand feeds one partial aggregate, so a section
costs a row for each of its keys and task, not a scan.  Sections whose keys grow with the data keep
their largest groups by rank within salts, then among the salts' winners; their totals are sums over
salts.  Nothing but these bounded rows meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .citations import entity_label

#: The fields that every classified record should have, and the counted states.
REQUIRED = ("primary_gmp_category", "regulatory_severity", "operational_severity", "inspection_risk", "market_relevance_au", "priority")
STATUSES = ("success", "cached", "failed", "not_applicable")
_SALTS = 64


@dataclass(frozen=True)
class Section:
    """A grouping set: its key columns, how many of its largest groups it keeps, which groups take
    part (SQL over keys and measures), and sums over all that do (SQL by name)."""

    keys: tuple[str, ...]
    keep: int = 1000
    where: str = "true"
    totals: Mapping[str, str] = field(default_factory=dict)


def by_case(choices: Mapping[str, object]) -> Column:
    out = F
    for section, value in choices.items():
        out = out.when(F.col("section") == section, value)
    return out.otherwise(None)


def sectioned(rows: DataFrame, sections: Mapping[str, Section], measures: Sequence[Column]) -> DataFrame:
    """(section, rank, keys, measures, totals); ``measures`` include the count ``n``.

    Groups with a null key are left out.  Ranks are by falling ``n``, then by the keys; a section
    without keys is the whole table and has one row even if that is empty."""
    names = list(dict.fromkeys(k for s in sections.values() for k in s.keys))
    bit = {n: 1 << (len(names) - 1 - i) for i, n in enumerate(names)}
    mask = {x: sum(b for n, b in bit.items() if n not in s.keys) for x, s in sections.items()}
    if len(set(mask.values())) < len(mask):
        raise ValueError("two sections have the same keys")
    label = F
    for x, m in mask.items():
        label = label.when(F.grouping_id(*names) == m, x)
    g = rows.groupingSets([list(s.keys) for s in sections.values()], *names).agg(label.alias("section"), *measures)
    filled = lambda s: " and ".join([f"({s.where})", *(f"{k} is not null" for k in s.keys)])
    g = g.where(by_case({x: F.expr(filled(s)) for x, s in sections.items()}))
    sums = sorted({t for s in sections.values() for t in s.totals})
    total = {t: by_case({x: F.expr(s.totals[t]).cast("long") for x, s in sections.items() if t in s.totals}) for t in sums}
    order = [F.desc("n"), *map(F.asc, names)]
    keep = by_case({x: F.lit(s.keep) for x, s in sections.items()})
    own = Window.partitionBy("section", F.pmod(F.xxhash64(*names), F.lit(_SALTS)))
    g = g.select("*", F.row_number().over(own.orderBy(*order)).alias("_near"), *[F.sum(c).over(own).alias(f"_{t}") for t, c in total.items()]).where(F.col("_near") <= keep)
    whole = Window.partitionBy("section")
    g = g.select("*", F.row_number().over(whole.orderBy(*order)).alias("rank"), *[F.sum(F.when(F.col("_near") == 1, F.col(f"_{t}"))).over(whole).alias(t) for t in sums])
    return g.where(F.col("rank") <= keep).drop("_near", *[f"_{t}" for t in sums])


def blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def count_filled(name: str) -> Column:
    return F.count_if(~blank(name))


def listed(section: str, *fields: Column | str) -> Column:
    """The section's rows in rank order as an array of structs (of rows already bounded by rank)."""
    rows = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("rank", F.struct(*fields).alias("x")))))
    return F.transform(rows, lambda r: r["x"])


def counted(section: str, key: str) -> Column:
    """The section's counts by key, largest first."""
    return F.map_from_entries(listed(section, key, "n"))


def only(section: str, name: str) -> Column:
    """A measure or total of a section's first row, 0 without one."""
    return F.coalesce(F.max(F.when((F.col("section") == section) & (F.col("rank") == 1), F.col(name))), F.lit(0))


def absent(c: DataFrame, *names: str) -> DataFrame:
    """``c`` with blank columns for those of ``names`` that it lacks."""
    return c.withColumns({n: F.lit(None).cast("string") for n in names if n not in c.columns})


def enrichment_groups(c: DataFrame) -> DataFrame:
    """Sections of the enrichment audit of a clustered citation table."""
    c = absent(c, "ai_summary", "ai_confidence", "recommended_action", "decision_summary", "raw_listing_summary")
    top = F.col("priority").isin("P1", "P2")
    key = lambda name, value: F.when(top, F.coalesce(value, F.lit(""))).alias(name)
    filled = lambda name: F.when(~blank(name), F.col(name))
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | blank(name)
    in_cluster = ~blank("cluster_id") & (F.col("cluster_size") > 1)
    rows = c.select(
        "*", filled("enrichment_status").alias("k_status"), filled("priority").alias("k_priority"), filled("primary_gmp_category").alias("k_category"), filled("failure_mode").alias("k_mode"),
        filled("regulatory_pressure").alias("k_pressure"), key("entity", entity_label(c)), key("k_authority", F.col("authority")), key("k_type", F.col("source_type")), key("k_failure", F.col("failure_mode")),
        F.when(in_cluster, F.col("cluster_id")).alias("k_cluster"), missing.alias("_missing"), F.date_format("date", "yyyy-MM-dd").alias("_day"),
    )
    lead = F.struct("cluster_label", "authority", "source_type", F.coalesce("failure_mode", F.lit("")).alias("failure_mode"), F.coalesce("cluster_priority", "priority", F.lit("")).alias("priority"))
    sections = {
        "all": Section(()),
        "status": Section(("k_status",)),
        "priority": Section(("k_priority",)),
        "category": Section(("k_category",), keep=10),
        "mode": Section(("k_mode",), keep=5),
        "pressure": Section(("k_pressure",)),
        "p1p2": Section(("entity", "k_authority", "k_type", "k_failure"), keep=20, where="n >= 2"),
        "cluster": Section(("k_cluster",), keep=10, totals={"groups": "1", "grouped": "n", "p1_groups": "if(p1 > 0, 1, 0)", "p2_groups": "if(p2 > 0 and p1 = 0, 1, 0)"}),
    }
    measures = [
        F.count("*").alias("n"), F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("priority") == "P2").alias("p2"), count_filled("ai_summary").alias("ai"), F.count_if(F.col("ai_confidence").cast("double") >= 0.7).alias("ai_high"),
        F.count_if("_missing").alias("missing"), count_filled("raw_listing_summary").alias("raw"), count_filled("decision_summary").alias("decision"), count_filled("recommended_action").alias("action"),
        F.min_by(lead, F.struct(~F.coalesce("cluster_primary", F.lit(False)), "id")).alias("lead"), F.min("_day").alias("first_day"), F.max("_day").alias("last_day"), F.count("_day").alias("dated"),
    ]
    return sectioned(rows, sections, measures)


def enrichment_audit(c: DataFrame, as_of: str, failed_sources: Sequence[str] = (), calls: Mapping[str, int] | None = None, sample: Mapping[str, int] | None = None, attempted: bool = False, completed: bool = False, import_error: str = "") -> DataFrame:
    """One nested row: totals, states, model answers, data quality, distributions, P1/P2 groups and clusters.

    ``calls`` are the model-call counters, of which ``accepted`` and ``discarded`` are reported among the data's
    quality; without them every row with an answer counts as accepted.  Ties are by key."""
    g = enrichment_groups(c)
    span = F.when(F.col("dated") >= 2, F.concat("first_day", F.lit("–"), "last_day")).otherwise(F.coalesce("first_day", F.lit("")))
    whole = lambda name: only("all", name)
    state = lambda s: F.coalesce(F.max(F.when((F.col("section") == "status") & (F.col("k_status") == s), F.col("n"))), F.lit(0)).alias(s)
    numbers = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv]) if x else F.create_map().cast("map<string,int>")
    return g.agg(
        F.lit(as_of).alias("generated_at"),
        whole("n").alias("total_citations"),
        F.struct(*map(state, STATUSES)).alias("enrichment"),
        F.struct(F.lit(attempted).alias("attempted"), F.lit(completed).alias("completed"), F.lit(import_error or None).cast("string").alias("import_error"), whole("ai").alias("total_with_ai"), whole("ai_high").alias("confidence_high"), (whole("ai") - whole("ai_high")).alias("confidence_low")).alias("ai_pass"),
        numbers(calls).alias("ai_call_tracking"),
        numbers(sample).alias("sample"),
        F.struct(
            whole("missing").alias("missing_required_intelligence_fields_count"), whole("raw").alias("raw_listing_summary_populated"), (whole("n") - whole("raw")).alias("raw_listing_summary_blank"), whole("decision").alias("decision_summary_populated_count"), whole("action").alias("recommended_action_populated_count"),
            (F.lit(calls.get("accepted", 0)).cast("long") if calls else whole("ai")).alias("ai_results_accepted_count"), F.lit((calls or {}).get("discarded", 0)).cast("long").alias("ai_results_discarded_low_confidence_count"),
        ).alias("data_quality"),
        counted("priority", "k_priority").alias("priority_breakdown"),
        counted("category", "k_category").alias("top_categories"),
        counted("mode", "k_mode").alias("top_failure_modes"),
        counted("pressure", "k_pressure").alias("regulatory_pressure"),
        listed("p1p2", F.col("entity").alias("entity_label"), F.col("k_authority").alias("authority"), F.col("k_type").alias("source_type"), F.col("k_failure").alias("failure_mode"), F.col("p1").alias("count_p1"), F.col("p2").alias("count_p2"), F.col("n").alias("total")).alias("p1p2_clusters"),
        F.struct(
            only("cluster", "groups").alias("total_clusters"), only("cluster", "groups").alias("multi_record_clusters"), only("cluster", "grouped").alias("grouped_records_count"), only("cluster", "p1_groups").alias("p1_clusters"), only("cluster", "p2_groups").alias("p2_clusters"),
            listed("cluster", F.col("k_cluster").alias("cluster_id"), F.col("n").alias("size"), F.col("lead.cluster_label").alias("label"), "lead.authority", "lead.source_type", "lead.failure_mode", "lead.priority", span.alias("date_range"), F.col("p1").alias("p1_count"), F.col("p2").alias("p2_count")).alias("top_10_clusters"),
        ).alias("clustering"),
        F.array(*map(F.lit, failed_sources)).cast("array<string>").alias("failed_sources"),
    )


def audit_lines(report: DataFrame) -> DataFrame:
    """(section, label, n, detail) of a nested enrichment audit: one row a figure."""
    pair = lambda section, label, n, detail="": F.struct(F.lit(section).alias("section"), F.coalesce(label, F.lit("")).alias("label"), n.cast("long").alias("n"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    fields = lambda name: F.array(*[pair(name, F.lit(f.name), F.col(f"{name}.{f.name}")) for f in report.schema[name].dataType.fields if f.dataType.typeName() in ("long", "integer")])
    maps = lambda name: F.transform(F.map_entries(name), lambda e: pair(name, e["key"], e["value"]))
    joined = lambda x, *names: F.concat_ws("|", *[x[n].cast("string") for n in names])
    parts = [
        F.array(pair("total", F.lit("total_citations"), F.col("total_citations"))), *map(fields, ("enrichment", "ai_pass", "data_quality", "clustering")),
        *map(maps, ("priority_breakdown", "top_categories", "top_failure_modes", "regulatory_pressure", "ai_call_tracking", "sample")),
        F.transform("p1p2_clusters", lambda x: pair("p1p2_clusters", joined(x, "entity_label", "authority", "source_type", "failure_mode"), x["total"], joined(x, "count_p1", "count_p2"))),
        F.transform("clustering.top_10_clusters", lambda x: pair("top_10_clusters", x["cluster_id"], x["size"], joined(x, "label", "authority", "source_type", "failure_mode", "priority", "date_range", "p1_count", "p2_count"))),
        F.transform("failed_sources", lambda x: pair("failed_sources", x, F.lit(1))),
    ]
    return report.select(F.inline(F.concat(*parts)))


def write_report(report: DataFrame, path: str) -> None:
    """A report of one bounded row as JSON."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
