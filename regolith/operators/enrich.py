"""Model-backed enrichment: who is eligible, in what order, within what budget, and how
answers come back.  The client is injected; the stub is deterministic and calls nothing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rank_of

Client = Callable[[str], str]
BOILERPLATE = r"(?i)(firm initiated recall|subject to recall at the retail level|voluntary recall|for more information|customers who purchased)"


def is_boilerplate(text: Column, least: int = 3) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BOILERPLATE), 1)) >= least


def queue_tier(least_text: int = 100) -> Column:
    """1 (first) to 6: rich P1, rich P2, cluster primaries, relevant P1/P2, letters, the rest."""
    fresh = F.coalesce("ai_summary", F.lit("")) == ""
    rich = F.length(F.coalesce("enriched_text", F.lit(""))) > least_text
    p = F.coalesce(F.nullif("priority", F.lit("")), F.lit("P4"))
    return (
        F.when(fresh & rich & (p == "P1"), 1)
        .when(fresh & rich & (p == "P2"), 2)
        .when(F.coalesce("cluster_primary", F.lit(True)) & fresh, 3)
        .when(F.col("market_relevance_au").isin("direct", "indirect", "reference") & p.isin("P1", "P2"), 4)
        .when((F.col("source_type") == "warning_letter") & F.col("enrichment_status").isin("success", "cached"), 5)
        .otherwise(6)
    )


def eligible(c: DataFrame, cache: DataFrame | None = None, least_text: int = 100, least_alert: int = 500, least_low: int = 300) -> DataFrame:
    """Rows worth a call: enriched, unanswered, not boilerplate, not in the cache (id, hash)."""
    n = F.length(F.coalesce("enriched_text", F.lit("")))
    low = F.col("priority").isin("P3", "P4") & ~F.coalesce("cluster_primary", F.lit(True)) & ~F.col("market_relevance_au").isin("direct", "indirect", "reference")
    rows = c.where(F.col("enrichment_status").isin("success", "cached") & (n > least_text) & (F.coalesce("ai_summary", F.lit("")) == ""))
    rows = rows.where(~((F.col("source_type") == "import_alert") & (n <= least_alert)) & ~(low & (n <= least_low)) & ~is_boilerplate(F.col("enriched_text")))
    rows = rows.withColumn("enriched_text_hash", F.substring(F.sha2(F.substring("enriched_text", 1, 100), 256), 1, 16))
    return rows if cache is None else rows.join(cache.select("id", "enriched_text_hash"), ["id", "enriched_text_hash"], "left_anti")


def queue(c: DataFrame, budget: int = 25, cache: DataFrame | None = None) -> DataFrame:
    """The rows to ask about, best tier first, at most ``budget``."""
    rows = eligible(c, cache).withColumn("tier", queue_tier())
    return rows.orderBy("tier", "id").limit(budget)


def sample_tier(as_of: str, letter_mark: str = "warning-letter", tga_mark: str = "tga.gov.au") -> Column:
    """Enrichment order of source types; future dates go ten places back."""
    kind = F.col("source_type")
    tier = (
        F.when((kind == "warning_letter") & F.col("url").contains(letter_mark), 0)
        .when(kind.isin("compliance_action", "inspection_finding") & F.col("url").contains(tga_mark), 1)
        .when(kind.isin("drug_enforcement", "device_enforcement", "food_enforcement"), 2)
        .when(kind.isin("recall", "safety_alert", "compliance_action", "inspection_finding"), 3)
        .when(kind == "import_alert", 4)
        .otherwise(5)
    )
    return tier + F.when(F.col("date") > F.lit(as_of).cast("date"), 10).otherwise(0)


def sample(c: DataFrame, n: int, strategy: str, as_of: str) -> DataFrame:
    """``n`` rows: most recent, most enrichable, or a mix of both."""
    newest = [F.desc_nulls_last("date"), F.col("id")]
    if strategy == "enrichable":
        return c.orderBy(sample_tier(as_of), *newest).limit(n)
    if strategy == "mixed":
        return c.orderBy(F.floor(sample_tier(as_of) / 3), *newest).limit(n)
    return c.orderBy(*newest).limit(n)


def salvage_json(answer: Column, schema: str) -> Column:
    """An answer's object: the whole text, else its outermost braces."""
    whole = F.from_json(answer, schema, {"mode": "PERMISSIVE"})
    block = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
    return F.when(F.trim(answer).rlike(r"(?s)^\{.*\}$"), whole).otherwise(block)


def clamp(c: Column) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def stub_client(prompt: str) -> str:
    """A deterministic answer from the prompt's words."""
    low = prompt.lower()
    mood = "negative" if any(w in low for w in ("recall", "contamination", "death", "warning")) else "neutral"
    return "Answer: " + json.dumps({"sentiment": mood, "confidence": min(1.0, len(prompt) / 100), "summary": prompt[:60]})


def ask(rows: DataFrame, key: str, prompt: str, client: Client = stub_client) -> DataFrame:
    """(key, answer) of one call a row; filter and limit before this, nothing is pushed below it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "answer": [client(p) for p in b["prompt"]]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(prompt).alias("prompt")).mapInPandas(run, f"{key} {kind}, answer string")


ANSWER = "sentiment string, confidence double, summary string"


def sentiment_answers(answers: DataFrame, key: str) -> DataFrame:
    """(key, sentiment, sentiment_confidence, ai_summary); failures are neutral with confidence 0."""
    j = answers.withColumn("j", salvage_json(F.col("answer"), ANSWER))
    known = rank_of(F.col("j.sentiment"), ["positive", "neutral", "negative"], -1) >= 0
    return j.select(key, F.when(known, F.col("j.sentiment")).otherwise("neutral").alias("sentiment"), F.when(known, clamp(F.col("j.confidence"))).otherwise(0.0).alias("sentiment_confidence"), F.nullif("j.summary", F.lit("")).alias("ai_summary"))


def token_totals(calls: DataFrame) -> DataFrame:
    """(phase, calls, input_tokens, output_tokens) of model calls (phase, input_tokens, output_tokens)."""
    return calls.groupBy("phase").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
