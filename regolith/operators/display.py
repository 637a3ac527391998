"""Text derivations for display, matching and review."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as S
from ..functions import rules as R
from ..functions.expr import any_of, blank_to_null, first_match, joined_filled

# Name parts
UPPER = ["LLC", "LLP", "LP", "PLC", "PC", "USA", "US", "UK", "AU", "FDA", "TGA", "GMP", "CGMP", "EU", "UN", "AB", "AG"]
SUFFIX = {"inc": "Inc.", "inc.": "Inc.", "ltd": "Ltd.", "ltd.": "Ltd.", "corp": "Corp.", "corp.": "Corp.", "co.": "Co."}
SMALL = ["and", "the", "of", "for", "by", "in", "at", "to", "a", "an", "or"]
GENERIC = ["clinical trial on vitamin b", "positive results could substantiate efficacy claims for premium", "efficacy claims for premium vms", "positive signal for vms", "monitor for regulatory implications"]
ANCHOR = r"(?i)(?:significant violations?|violations? are as follows|findings? are as follows|observations? are as follows|during (?:our|the) inspection|we observed the following|the following observations?|you failed to|failure to|failed to (?:establish|maintain|implement|develop|document)|were not in compliance|is not in compliance|did not (?:develop|establish|maintain)|you have not|following deficiencies)[:\s]+"
ANCHOR_WORDS = ["violation", "inspection finding", "failed to", "you have not"]


def entity_name(raw: Column) -> Column:
    """Title case by word, with fixed spellings for legal forms and small words.

    Words are split at blanks; punctuation around a word stays where it is."""
    lead = lambda w: F.regexp_extract(w, r"^[^\w]*", 0)
    tail = lambda w: F.regexp_extract(w, r"[^\w.]*$", 0)

    def one(w: Column, i: Column) -> Column:
        core = F.substring(w, F.length(lead(w)) + 1, F.length(w) - F.length(lead(w)) - F.length(tail(w)))
        low, up = F.lower(core), F.regexp_replace(F.upper(core), r"\.$", "")
        fixed = F.lit(None).cast("string")
        for k, v in SUFFIX.items():
            fixed = F.when(low == k, v).otherwise(fixed)
        cased = F.concat(F.upper(F.substring(core, 1, 1)), F.lower(core.substr(F.lit(2), F.length(core))))
        out = F.when(low == "d/b/a", low).when(up.isin(*UPPER), up).when(fixed.isNotNull(), fixed).when(low.isin(*SMALL) & (i > 0), low).otherwise(cased)
        return F.concat(lead(w), out, tail(w))

    return F.array_join(F.transform(F.split(F.coalesce(raw, F.lit("")), " "), one), " ")


def redact(text: Column) -> Column:
    """Markers of withheld text become ``[redacted]``; runs of blanks one blank."""
    return F.regexp_replace(F.regexp_replace(text, r"\(b\)\(\d+\)", "[redacted]"), r"\s{2,}", " ")


def violation_snippet(text: Column, most: int = 2000, sentences: int = 8) -> Column:
    """From the first anchor phrase, at most eight sentences; else from a sentence with a
    violation word; else from the salutation; else the beginning."""
    t = redact(text)
    anchored = F.regexp_extract(t, f"(?s){ANCHOR}.*", 0)
    parts = F.split(F.trim(F.substring(anchored, 1, most)), r"(?<=[.!?])\s+(?=[A-Z])")
    out = F.when(anchored != "", F.substring(F.trim(F.array_join(F.slice(parts, 1, sentences), " ")), 1, most))
    for word in ANCHOR_WORDS:
        at = F.locate(word, F.lower(t))
        window = F.substring(t, F.greatest(at - 200, F.lit(1)), F.least(at - 1, F.lit(200)))
        back = F.length(F.regexp_extract(window, r"(?s)(?:.*\. )?(.*)$", 1))
        start = F.when(F.instr(window, ". ") > 0, at - back).otherwise(F.lit(2))
        out = out.when(at > 0, F.trim(t.substr(start, F.lit(most))))
    dear = F.locate("Dear ", t)
    return out.when(dear > 0, F.trim(t.substr(dear, F.lit(most)))).otherwise(F.substring(t, 1, most))


def ingredient(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "Unknown") -> Column:
    """First ingredient of an ordered table of (name, phrases), which the caller supplies."""
    return first_match(F.lower(text), rules, default)


def title_ingredient(title: Column) -> Column:
    """The first known ingredient term, in the terms' order, that a title contains, else null."""
    return S.first(F.lower(title), R.KNOWN_INGREDIENTS)


def evidence_terms(c: DataFrame) -> DataFrame:
    """Adds ``terms``, the primary category's evidence phrases in all of a record's texts, and ``enriched``, whether
    the enriched text alone has one.  A category without phrases has none."""
    rules = tuple(R.EVIDENCE.items())
    own = F.element_at(F.create_map(*[x for label, p in rules for x in (F.lit(label), S.literal(p))]), F.col("primary_gmp_category"))
    within = lambda text: F.coalesce(F.array_intersect(own, S.found(F.lower(text), S.all_of(rules))), S.literal([]))
    text = joined_filled("violation_details", "raw_listing_summary", "summary", "enriched_text")
    return c.withColumns({"terms": within(text), "enriched": F.size(within(F.coalesce("enriched_text", F.lit("")))) > 0})


def equipment_trace(c: DataFrame) -> DataFrame:
    """Adds ``has_evidence`` (an equipment term among the evidence phrases), ``low_value`` (a noise word in title or
    summary) and ``reason``, why a record counts as equipment and facilities: its category, else the
    legacy one, and its failure mode."""
    c = c.withColumns({n: F.lit("") for n in ("title", "category") if n not in c.columns})
    phrases = F.concat_ws(" ", F.coalesce("category_evidence", S.literal([])), F.coalesce("failure_mode_evidence", S.literal([])))
    some = lambda text, terms: F.size(S.found(F.lower(text), terms)) > 0
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    quoted = lambda name, column, after="": F.concat(F.lit(f"{name}='"), F.col(column), F.lit(f"'{after}"))
    category = F.when(F.col("primary_gmp_category").isin(R.EQUIPMENT_CATEGORIES), quoted("primary_gmp_category", "primary_gmp_category")).when(F.col("category").isin(R.EQUIPMENT_CATEGORIES), quoted("legacy category", "category", " (no primary_gmp_category match)"))
    mode = F.when(F.col("failure_mode").isin(R.EQUIPMENT_MODES), quoted("failure_mode", "failure_mode"))
    reason = F.nullif(F.concat_ws("; ", category, mode), F.lit(""))
    return c.withColumns({"has_evidence": some(phrases, R.EQUIPMENT_TERMS), "low_value": some(text, R.NOISE), "reason": F.coalesce(reason, F.lit("UNKNOWN — should not appear here"))})


def is_generic(text: Column) -> Column:
    return (F.coalesce(text, F.lit("")) == "") | any_of(F.lower(text), GENERIC)


def signal_text(columns: Sequence[str]) -> Column:
    return F.lower(joined_filled(*columns))


def loose_match(hay: Column, query: str) -> Column:
    """The query, or any of its terms of three letters or more, is in a lower-case text."""
    terms = [t for t in re.split(r"[\s/\-]+", query.lower()) if len(t) > 2]
    return hay.contains(query.lower()) | any_of(hay, terms)


def strict_match(hay: Column, name_column: Column, name: str) -> Column:
    """Equal name, or the name between delimiters; a digit may follow it."""
    low = name.lower().strip()
    return (F.lower(F.trim(F.coalesce(name_column, F.lit("")))) == low) | hay.rlike(r"(?:^|[\s,.(/\-])" + re.escape(low) + r"(?:[\s,.)/\-\d]|$)")


def why_it_matters(total: Column, high: Column, negative: Column, trend: Column) -> Column:
    s = lambda n: F.when(n > 1, "s").otherwise("")
    share = F.round(negative / total * 100).cast("int").cast("string")
    return (
        F.when((trend == "rising") & (high > 0), F.concat(high.cast("string"), F.lit(" high-severity signal"), s(high), F.lit(" with rising activity — regulatory attention or emerging safety concern.")))
        .when(trend == "rising", F.concat(F.lit("Activity up this week ("), total.cast("string"), F.lit(" signals) — emerging market interest or pending scrutiny. Flag for client briefing.")))
        .when(high > 2, F.concat(high.cast("string"), F.lit(" high-severity alerts — review labeling and claims for compliance exposure now.")))
        .when((total > 0) & (negative * 10 > total * 6), F.concat(F.lit("Majority negative sentiment ("), share, F.lit("%) — monitor for enforcement or claim challenge risk.")))
        .otherwise(F.concat(total.cast("string"), F.lit(" signal"), s(total), F.lit(" tracked across regulatory, research and adverse event sources.")))
    )


def issue_action(issues: DataFrame, actions: DataFrame, default: str) -> DataFrame:
    """(issue, action): exact label, else the first that contains the other, else a default.

    ``actions`` (ord, label, action) is a configured table of a few rows."""
    a = F.broadcast(actions)
    i, k = F.lower("issue"), F.lower("label")
    hit = issues.join(a, i.contains(k) | k.contains(i), "left")
    best = hit.groupBy("issue").agg(F.min_by("action", F.struct((F.col("issue") != F.col("label")).alias("x"), "ord")).alias("action"))
    return best.select("issue", F.when(F.col("issue") == "Unclassified", None).otherwise(F.coalesce("action", F.lit(default))).alias("action"))


def narrative(signals: DataFrame) -> DataFrame:
    """One sentence on volume, authorities, severity and the first five ingredients seen."""
    n = signals.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("severity") == "medium").alias("m"))
    by = signals.groupBy(F.upper("authority").alias("a")).agg(F.count("*").alias("c"), F.min("rec_no").alias("o"))
    auth = by.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "o", "a"))), lambda x: F.concat(x["a"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(")"))), ", ").alias("auth"))
    known = signals.where("coalesce(ingredient_name, '') <> '' and lower(trim(ingredient_name)) <> 'unknown'")
    first = known.groupBy("ingredient_name").agg(F.min("rec_no").alias("o")).orderBy("o").limit(5)
    ing = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "ingredient_name"))), lambda x: x["ingredient_name"]), ", ").alias("ing"))
    low = F.col("n") - F.col("h") - F.col("m")
    part = lambda c, label: F.when(c > 0, F.concat(c.cast("string"), F.lit(f" {label}")))
    sev = F.when(F.col("h") == F.col("n"), F.concat(F.lit("all "), F.col("h").cast("string"), F.lit(" HIGH severity"))).when(F.col("h") > 0, F.concat(F.concat_ws(" and ", part(F.col("h"), "HIGH"), part(F.col("m"), "MEDIUM"), part(low, "LOW")), F.lit(" severity"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" signals across medium and low severity")))
    rows = n.join(auth).join(ing)  # three tables of one row each
    return rows.select(F.concat(F.lit("This period saw "), F.col("n").cast("string"), F.lit(" new regulatory signals from "), "auth", F.lit(", "), sev, F.lit("; key ingredients include "), "ing", F.lit(".")).alias("narrative"))


def few_shot(corrections: DataFrame) -> DataFrame:
    """One text of numbered corrections (ord, title, rating, correction_note)."""
    line = F.concat(F.lit("Example "), (F.col("x.ord")).cast("string"), F.lit(" (marked as "), F.col("x.rating"), F.lit("): "), F.substring("x.title", 1, 100), F.lit(" — "), F.col("x.correction_note"))
    rows = corrections.select(F.struct("ord", "title", "rating", "correction_note").alias("x")).select("x", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.ord", "line"))), lambda s: s["line"]), "\n").alias("examples"))


def quality_fields(j: Column) -> list[Column]:
    """Model answer fields under their own or older names."""
    pick = lambda name, *olds: F.coalesce(*[F.nullif(j[x], F.lit("")) for x in (name, *olds)], F.lit("")).alias(name)
    return [pick("potential_impact", "regulatory_impact"), pick("competitor_signal", "competitive_signal"), pick("market_significance", "market_relevance")]


def source_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``source_label`` from a small (authority, label) table."""
    return rows.join(F.broadcast(labels), "authority", "left").withColumn("source_label", F.coalesce("label", F.lit("Unknown Source"))).drop("label")


def claim_ranking(rows: DataFrame, categories: dict[str, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """(category, total, high, risk): a row counts in each category whose word it has."""
    text = signal_text(columns)
    tags = F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in categories.items()]))
    g = rows.select(F.explode(tags).alias("category"), (F.col("severity") == "high").alias("h")).groupBy("category").agg(F.count("*").alias("total"), F.count_if("h").alias("high"))
    return g.withColumn("risk", F.when(F.col("high") * 2 > F.col("total"), "H").when(F.col("high") * 5 > F.col("total"), "M").otherwise("L"))


def suspicion(c: DataFrame) -> DataFrame:
    """Adds reason flags and the level ok, weak or suspicious."""
    un = F.col("classification_status") == "unconfirmed"
    bare = F.size("category_evidence") == 0
    both = bare & (F.size("failure_mode_evidence") == 0)
    flags = F.array_compact(F.array(F.when(un, F.lit("unconfirmed")), F.when(bare, F.lit("no category evidence")), F.when(both, F.lit("no evidence"))))
    return c.withColumn("flags", flags).withColumn("level", F.when(F.size("flags") == 0, "ok").when(un | (F.size("flags") >= 2), "suspicious").otherwise("weak"))


def suspicious_reasons(c: DataFrame) -> DataFrame:
    """Rows with at least one reason to doubt their classification, and the reasons."""
    from .citations import is_enforcement, is_guidance, title_text

    soft = is_guidance(F.col("url"), title_text()) & ~is_enforcement(title_text())
    found = F.col("source_type") == "inspection_finding"
    reasons = F.array_compact(F.array(
        F.when((F.col("primary_gmp_category") == "Deviation management") & (F.size("category_evidence") == 0), F.lit("R1")),
        F.when((F.col("primary_gmp_category") == "Quality management system") & soft, F.lit("R2")),
        F.when(found & soft, F.lit("R3")),
        F.when((F.size("category_evidence") == 0) & (F.col("classification_confidence") < 0.5) & (F.col("primary_gmp_category") != "Other / Insufficient Detail"), F.lit("R4")),
        F.when(found & F.col("authority").isin("EFSA", "BfR"), F.lit("R5")),
        F.when(~F.col("failure_mode").isin("", "insufficient_detail") & (F.col("failure_mode_confidence") < 0.2) & (F.col("primary_gmp_category") != "Other / Insufficient Detail"), F.lit("R6")),
        F.when(found & F.coalesce("url", F.lit("")).contains("gov.uk/guidance"), F.lit("R7")),
    ))
    return c.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def inferred_status(c: DataFrame) -> Column:
    """Status from evidence where none is stored."""
    bare, specific = F.size("category_evidence") == 0, F.col("primary_gmp_category") != "Other / Insufficient Detail"
    sure = (F.length(F.coalesce("best_text", F.lit(""))) > 200) | (F.col("classification_confidence") >= 0.5)
    return F.when(bare & specific, "unconfirmed").when(~bare & sure, "confirmed").otherwise("provisional")


def evidence_backed(c: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds ``backed``: not unconfirmed, and an evidence phrase has one of the terms."""
    text = F.lower(F.concat_ws(" ", F.array_join("category_evidence", " "), F.array_join("failure_mode_evidence", " ")))
    return c.withColumn("backed", (F.col("classification_status") != "unconfirmed") & any_of(text, terms))


def best_filter(c: DataFrame) -> DataFrame:
    """The larger of the top failure mode and the top category; the mode wins ties."""
    count = lambda col, kind, rank: c.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(rank).alias("r"), "value", "n")
    both = count("failure_mode", "failure_mode", 0).unionByName(count("primary_gmp_category", "primary_gmp_category", 1))
    return both.orderBy(F.desc("n"), "r", "value").limit(1).drop("r")


def or_unknown(name: str) -> Column:
    return F.coalesce(blank_to_null(name), F.lit("Unknown"))
