"""Alert rules: six triggers over signals, trends and sentiment; one fired row a rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "rule_name string, trigger_type string, filters struct<ingredient_list: array<string>, source_list: array<string>, min_severity: string, extra_field: string, extra_value: string, "
    "min_spike_ratio: double, min_shift: double, direction: string, from_type: string, to_type: string>, channels array<string>, frequency string"
)


@dataclass(frozen=True)
class Rule:
    """A rule with the defaults that each trigger assumes."""

    name: str = "Unnamed rule"
    trigger: str = ""
    ingredients: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    min_severity: str = "low"
    extra_field: str | None = None
    extra_value: str | None = None
    min_spike_ratio: float = 2.0
    min_shift: float = 0.3
    direction: str = "negative"
    from_type: str = ""
    to_type: str = ""
    channels: tuple[str, ...] = field(default=("email",))
    frequency: str = "daily_digest"


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a JSON file: the configuration, read once on the driver."""
    out = []
    for r in spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path).collect():
        f = r.filters.asDict() if r.filters else {}
        given = {"ingredients": f.pop("ingredient_list", None), "sources": f.pop("source_list", None), **f}
        given |= {"name": r.rule_name, "trigger": r.trigger_type, "channels": r.channels, "frequency": r.frequency}
        out.append(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None}))
    return out


def severity_rank(c: Column) -> Column:
    return F.when(F.lower(c) == "high", 3).when(F.lower(c) == "medium", 2).otherwise(1)


def _source(rule: Rule) -> Column:
    return F.lower("authority").isin(*[s.lower() for s in rule.sources]) if rule.sources else F.lit(True)


def _severe(rule: Rule) -> Column:
    return severity_rank(F.col("severity")) >= severity_rank(F.lit(rule.min_severity))


def match(rule: Rule, signals: DataFrame, spikes: DataFrame, sentiment: DataFrame, shifts: DataFrame) -> DataFrame | None:
    """Rows (item) that make the rule fire; None for a trigger that does not exist."""
    name = F.lower(F.trim("ingredient_name"))
    if rule.trigger == "ingredient_mention":
        hit = F.lit(not rule.ingredients)
        for k in rule.ingredients:
            hit = hit | name.contains(k.lower())
        return signals.where(hit & _source(rule)).select(name.alias("item"))
    if rule.trigger == "severity_threshold":
        hit = _severe(rule) & _source(rule)
        if rule.extra_field is not None and rule.extra_field in signals.columns:
            hit = hit & (F.lower(F.col(rule.extra_field).cast("string")) == (rule.extra_value or "").lower())
        return signals.where(hit).select(name.alias("item"))
    if rule.trigger == "new_source_signal":
        return signals.where(_source(rule) & _severe(rule)).select(F.lower("authority").alias("item"))
    if rule.trigger == "trend_spike":
        return spikes.where(F.col("spike_ratio") >= rule.min_spike_ratio).select(F.col("ingredient").alias("item"))
    if rule.trigger == "sentiment_shift":
        if rule.direction != "negative":
            return sentiment.where(F.lit(False)).select(F.col("ingredient").alias("item"))
        return sentiment.where(F.col("rising_risk") & (F.abs("shift") >= rule.min_shift)).select(F.col("ingredient").alias("item"))
    if rule.trigger == "claim_shift":
        hit = F.lit(True)
        if rule.from_type:
            hit = hit & (F.col("from_type") == rule.from_type)
        if rule.to_type:
            hit = hit & (F.col("to_type") == rule.to_type)
        return shifts.where(hit).select(F.col("ingredient").alias("item"))
    return None


def evaluate(rules: list[Rule], signals: DataFrame, spikes: DataFrame, sentiment: DataFrame, shifts: DataFrame) -> DataFrame:
    """(rule_name, trigger_type, frequency, matches, items): distinct items sorted, at most five
    but for severity thresholds and sources, which list all."""
    out = None
    for r in rules:
        rows = match(r, signals, spikes, sentiment, shifts)
        if rows is None:
            continue
        named = rows.select(F.lit(r.name).alias("rule_name"), F.nullif("item", F.lit("")).alias("item"))
        counted = named.groupBy("rule_name").agg(F.count("*").alias("matches"))
        distinct = named.where("item is not null").distinct()
        if r.trigger not in ("severity_threshold", "new_source_signal"):
            distinct = distinct.orderBy("item").limit(5)  # no list grows beyond what is shown
        listed = distinct.groupBy("rule_name").agg(F.array_sort(F.collect_list("item")).alias("items"))
        one = counted.join(listed, "rule_name", "left").select("rule_name", F.lit(r.trigger).alias("trigger_type"), F.lit(r.frequency).alias("frequency"), "matches", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return signals.sparkSession.createDataFrame([], "rule_name string, trigger_type string, frequency string, matches long, items array<string>")
    return out
