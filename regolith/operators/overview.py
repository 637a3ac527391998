"""Overview cards, trend labels, immediate actions and model-call accounting over citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import any_of, blank_to_null, first_match
from .display import is_generic
from .facets import Facets, base_issue, base_pool, collapse, display_issue, first_of

# The categories and failure modes that a trend label stands for
TREND_FILTERS = {
    "Equipment & facilities": (["Equipment & facilities", "Equipment / Facilities"], ["equipment_facilities", "equipment_facility", "cleaning_validation", "calibration"]),
    "Computerised systems validation": (["Computerised systems validation", "Computerised systems", "Computer systems"], ["computer_systems_validation", "computerised_systems", "data_integrity", "documentation_data_integrity"]),
    "Labelling & claims": (["Labelling & claims", "Labelling and claims"], ["labelling_claims", "labelling_error", "mislabelling"]),
    "Ingredient safety": (["Ingredient safety"], ["ingredient_safety", "identity_purity_testing", "undeclared_drug_substance", "contamination_chemical", "adulteration"]),
    "Contamination & sterility": (["Contamination & sterility", "Sterility assurance"], ["sterility_assurance", "contamination_microbial", "contamination_cross", "contamination_chemical"]),
    "Sterility assurance": (["Sterility assurance"], ["sterility_assurance"]),
    "Supply chain & procurement": (["Supply chain & procurement", "Supply chain"], ["supplier_qualification", "import_controls"]),
    "Batch release": (["Batch release"], ["batch_release"]),
    "Container closure integrity": (["Container closure integrity"], ["container_closure"]),
    "GMP violations": (["GMP violations"], ["deviation_capa", "process_validation", "documentation_data_integrity"]),
}
# A focus's kind and the facet it sets
FOCUS_FACETS = {"failure_mode": "failure_mode", "category": "category", "source_type": "source_type", "authority": "authority", "facility_type": "facility_type"}
PRIORITIES = ["P1", "P2", "P3", "P4"]


def legacy_category(c: DataFrame) -> Column:
    """The older category column where the table has it, else the primary one."""
    return F.coalesce(blank_to_null("category" if "category" in c.columns else "primary_gmp_category"), F.lit(""))


def category(c: DataFrame) -> Column:
    """The primary category, else the legacy one."""
    return F.coalesce(blank_to_null("primary_gmp_category"), legacy_category(c))


def trend_match(c: DataFrame, label: str) -> Column:
    """Whether a record's category or failure mode belongs to a trend label."""
    cats, modes = TREND_FILTERS[label]
    return category(c).isin(*cats) | F.coalesce("failure_mode", F.lit("")).isin(*modes)


def trend_filters(c: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, kind, value, n): each label's best filter: the most frequent of its modes or categories,
    the mode on a tie, then the value seen first; else the label as a category; none without a row.

    Rows are counted once by category and mode; only these few counts meet the labels."""
    counts = c.groupBy(category(c).alias("cat"), F.coalesce("failure_mode", F.lit("")).alias("fm")).agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    both = counts.select(F.explode(F.array(F.struct(F.lit("failure_mode").alias("kind"), F.col("fm").alias("value")), F.struct(F.lit("primary_gmp_category").alias("kind"), F.col("cat").alias("value")))).alias("x"), "n", "first")
    both = both.where("x.value <> ''").groupBy("x.kind", "x.value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    known = [(x, kind, v, i) for x in labels for i, (kind, vs) in enumerate(zip(("failure_mode", "primary_gmp_category"), TREND_FILTERS.get(x, ([], []))[::-1], strict=True)) for v in vs]
    known += [(x, "primary_gmp_category", x, 2) for x in labels]
    table = c.sparkSession.createDataFrame(known, "label string, kind string, value string, tier int")
    # the label's own name as a category counts only if no mapped value has a row
    hit = both.join(F.broadcast(table), ["kind", "value"])
    rank = F.struct((F.col("tier") == 2).alias("own"), (-F.col("n")).alias("n"), "tier", "first")
    return hit.groupBy("label").agg(F.min_by(F.struct("kind", "value", "n"), rank).alias("x")).select("label", "x.*")


def grouped_and_broader(c: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, grouped, broader) over the base pool, that is after the noise filter and without facets: rows
    of the label's best filter among cluster primaries, and all rows whose legacy category is the label."""
    pool = base_pool(c)
    best = trend_filters(pool.where("cluster_primary"), labels).select("label", F.col("n").alias("grouped"))
    wide = pool.where(legacy_category(pool).isin(*labels)).groupBy(legacy_category(pool).alias("label")).agg(F.count("*").alias("broader"))
    all_labels = pool.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return all_labels.join(F.broadcast(best), "label", "left").join(F.broadcast(wide), "label", "left").fillna(0)


def focus_facets(kind: str | None, value: str = "") -> Facets:
    """The facets that an overview focus stands for; an unknown kind restricts nothing."""
    name = FOCUS_FACETS.get(kind or "")
    return Facets(**{name: value}) if name else Facets()


def active_chips(f: Facets) -> list[tuple[str, str]]:
    """(option, value) of the options that restrict, in their order."""
    plain = Facets()
    return [(k, str(v)) for k, v in vars(f).items() if v != getattr(plain, k) and k != "noise_filter"]


def redundant(text: Column, c: DataFrame) -> Column:
    """Too short, or no more than the category's name."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(t, r"[.,;:\s]+$", "")
    out = F.length(t) < 4
    for name in ("category", "primary_gmp_category"):
        if name in c.columns:
            k = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
            out = out | ((k != "") & ((t == k) | (bare == k)))
    return out


def meaningful_detail(c: DataFrame, implications: Mapping[str, str]) -> DataFrame:
    """Adds ``detail``: violation details, decision summary, the first good text of the row's cluster, the
    category's implication, or the source type; the first that says anything.

    A cluster's first good text is one partial minimum a cluster."""
    good = lambda x: (F.length(x) > 25) & ~redundant(x, c)
    trimmed = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    text = F.coalesce(F.nullif(trimmed("decision_summary"), F.lit("")), trimmed("summary"))
    members = c.where("cluster_id is not null and not cluster_primary").withColumn("_t", text).where(good(F.col("_t")))
    first = members.groupBy("cluster_id").agg(F.min_by("_t", "rec_no").alias("_member"))
    out = c.join(first, "cluster_id", "left")
    meaning = F.lit(None).cast("string")
    for label, told in implications.items():
        meaning = F.when(category(c) == label, F.concat(F.substring_index(F.lit(told), ".", 1), F.lit("."))).otherwise(meaning)
    kind = F.regexp_replace(F.coalesce("source_type", F.lit("")), "_", " ")
    detail = (
        F.when(good(trimmed("violation_details")), F.substring(trimmed("violation_details"), 1, 130))
        .when(good(trimmed("decision_summary")), F.substring(trimmed("decision_summary"), 1, 130))
        .when(F.col("cluster_primary") & F.col("_member").isNotNull(), F.substring("_member", 1, 130))
        .when(meaning.isNotNull(), meaning)
        .when(kind != "", F.concat(F.lit("Grouped regulatory records — "), kind))
        .otherwise("Grouped regulatory records requiring source review")
    )
    return out.withColumn("detail", detail).drop("_member")


def visible_counts(c: DataFrame) -> DataFrame:
    """(issue, visible, p1, p2, p3, confirmed, provisional): an issue's rows as shown, a row a cluster."""
    rows = c.withColumn("issue", base_issue(display_issue()))
    shown = collapse_by(rows, "issue")
    by = lambda column, value: F.count_if(F.col(column) == value)
    return shown.groupBy("issue").agg(F.count("*").alias("visible"), *[by("priority", p).alias(p.lower()) for p in PRIORITIES[:3]], *[by("classification_status", s).alias(s) for s in ("confirmed", "provisional")])


def collapse_by(rows: DataFrame, key: str) -> DataFrame:
    """A row per (key, cluster): the primary, or the first in rec_no order if it isn't there."""
    return first_of(rows, F.col(key), F.coalesce("cluster_id", "id")).drop("other_members")


def top_names(rows: DataFrame, key: str, column: str, k: int, out: str) -> DataFrame:
    """(key, out): the ``k`` most frequent values of a column joined by commas, earlier ones first on ties."""
    n = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(key, column).agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", F.col(column).alias("v"))))  # one entry a distinct value
    return n.groupBy(key).agg(F.array_join(F.transform(F.slice(listed, 1, k), lambda x: x["v"]), ", ").alias(out))


def alert_cards(c: DataFrame) -> DataFrame:
    """Figures of every issue's card over its rows as shown: counts, four authorities, three facility types."""
    shown = collapse_by(c.withColumn("issue", base_issue(display_issue())), "issue")
    out = visible_counts(c).join(top_names(shown, "issue", "authority", 4, "authorities"), "issue", "left").join(top_names(shown, "issue", "facility_type", 3, "facilities"), "issue", "left")
    return out.withColumn("top_priority", F.when(F.col("p1") > 0, "P1").otherwise("P2"))


def card_preview(c: DataFrame, k: int = 5) -> DataFrame:
    """(issue, place, id): an issue's first rows as shown, by priority, then newest."""
    from pyspark.sql import Window

    shown = collapse_by(c.withColumn("issue", base_issue(display_issue())), "issue")
    order = Window.partitionBy("issue").orderBy(F.coalesce("priority", F.lit("P4")), F.desc_nulls_last("date"), "rec_no")
    return shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("issue", "place", "id")


def strip(c: DataFrame) -> DataFrame:
    """One row: most frequent category, authority and source type, rows and P1 rows before and after collapsing."""
    count = c.groupBy(F.coalesce(F.nullif(category(c), F.lit("")), F.lit("Other")).alias("category"), "authority", F.regexp_replace(F.coalesce("source_type", F.lit("other")), "_", " ").alias("source_type")).agg(F.count("*").alias("n"), F.min("rec_no").alias("first"))
    total = c.agg(F.lit(1).alias("one"), F.count("*").alias("records"), F.count_if(F.col("priority") == "P1").alias("p1_records"))
    shown = collapse(c).agg(F.lit(1).alias("one"), F.count("*").alias("visible"), F.count_if(F.col("priority") == "P1").alias("p1_visible"))
    out = total.join(shown, "one")
    for name in ("category", "authority", "source_type"):
        by = count.groupBy(name).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        out = out.join(by.agg(F.lit(1).alias("one"), F.min_by(name, F.struct((-F.col("n")).alias("n"), "first")).alias(f"top_{name}")), "one")
    return out.drop("one")


def immediate_actions(c: DataFrame, actions: Mapping[str, str]) -> DataFrame:
    """(place, urgency, title): at most three actions from one row of counts.

    Clusters of P1 or P2, else the leading category; high severity; supplements or the Australian agency."""
    s = lambda n: F.when(n != 1, "s").otherwise("")
    prime = F.coalesce("cluster_primary", F.lit(True))
    one = c.agg(
        F.count_if(prime & (F.col("priority") == "P1")).alias("p1"), F.count_if(prime & (F.col("priority") == "P2")).alias("p2"), F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("facility_type") == "Supplement / Nutraceutical").alias("supp"), F.count_if(F.col("authority") == "TGA").alias("tga"), F.lit(1).alias("one"),
    )
    by = c.groupBy(category(c).alias("cat")).agg(F.count("*").alias("n"), F.min("rec_no").alias("first")).where(~F.col("cat").isin("", "Other", R.NO_DETAIL))
    lead = by.agg(F.min_by(F.struct("cat", "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("lead"), F.lit(1).alias("one"))
    j = one.join(lead, "one")
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    p1, p2, high, supp, tga = (F.col(n) for n in ("p1", "p2", "high", "supp", "tga"))
    review = text("Review ", p1, " high-priority", F.when(p2 > 0, text(" + ", p2, " needs-review")).otherwise(""), " GMP enforcement cluster", s(p1 + p2), " requiring decision")
    first = F.when(p1 + p2 > 0, review).when(F.col("lead").isNotNull(), text("Review ", F.col("lead.cat"), " — ", F.col("lead.n"), " citation", s(F.col("lead.n"))))
    second = F.when(high > 0, text(high, " high-severity action", s(high), " require immediate attention"))
    third = F.when((supp >= tga) & (supp > 0), text(supp, " Supplement / Nutraceutical action", s(supp))).when(tga > 0, text(tga, " TGA action", s(tga), " on file — AU market priority"))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(u).alias("urgency"), t.alias("title")) for i, (u, t) in enumerate((("now", first), ("urgent", second), ("this-week", third)))])
    return j.select(F.explode(F.filter(rows, lambda x: x["title"].isNotNull())).alias("x")).select("x.*")


def enrichable(c: DataFrame) -> DataFrame:
    """Rows whose detail page is fetched: warning letters of one agency, notices of another."""
    return c.where("(source_type = 'warning_letter' and authority = 'FDA') or (authority = 'TGA' and source_type in ('compliance_action', 'safety_alert', 'recall'))")


def static_items(items: DataFrame, **facets: str) -> DataFrame:
    """Rows of a configured table whose facets equal those given; ``all`` does not restrict."""
    for name, value in facets.items():
        if value != "all":
            items = items.where(F.col(name) == value)
    return items


def static_sections(items: DataFrame, order: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    """(section, place, titles): the configured table's items by priority section, in their order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("priority"))
    g = items.groupBy("priority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]), "; ").alias("titles"))
    return g.select(F.col("priority").alias("section"), place.cast("int").alias("place"), "titles").where("place > 0")


def answered_category(answer: Column, text: Column, fallback: str = "GMP violations") -> Column:
    """A model's category: its answer if it names one, else the first with a word of four letters or
    more in the answer, else by the text's phrases."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    exact, word = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, _ in reversed(R.CATEGORY):
        exact = F.when(low == label.lower(), label).otherwise(exact)
        words = [w for w in label.lower().split() if len(w) > 3]
        word = F.when(any_of(low, words), label).otherwise(word)
    return F.coalesce(exact, word, first_match(F.lower(text), R.CATEGORY, fallback))


def call_counters(calls: DataFrame) -> DataFrame:
    """(phase, tier, calls, accepted, discarded, skipped) of model calls (phase, tier, outcome); a phase
    that is neither scraping nor enrichment is the intelligence pass."""
    phase = F.when(F.col("phase").isin("scraping", "enrichment"), F.col("phase")).otherwise("intelligence")
    is_ = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return calls.groupBy(phase.alias("phase"), "tier").agg(F.count_if(F.col("outcome") != "skipped").alias("calls"), is_("accepted"), is_("discarded"), is_("skipped"))


def prompt(template: str, most: int = 3000) -> Column:
    """The template with a signal's authority, title and body; the body is cut."""
    parts = {"{authority}": F.coalesce("authority", F.lit("")), "{title}": F.coalesce("title", F.lit("")), "{body}": F.substring(F.coalesce("body_text", F.lit("")), 1, most)}
    out = F.lit(template)
    for k, v in parts.items():
        out = F.replace(out, F.lit(k), v)
    return out


def own_words(label: Column) -> Column:
    """A signal's summary, else its sentiment's reasoning, or, if that is generic, a text from its source,
    type, ingredient and sentiment."""
    raw = F.coalesce(blank_to_null("ai_summary"), blank_to_null("sentiment_reasoning"), F.lit(""))
    name = F.when(F.coalesce("ingredient_name", F.lit("")).isin("", "unknown"), F.lit("")).otherwise(F.col("ingredient_name"))
    kind = F.when(F.coalesce("event_type", F.lit("")).isin("", "other"), F.lit("research signal")).otherwise(F.regexp_replace("event_type", "_", " "))
    sent = F.lower(F.coalesce("sentiment", F.lit("")))
    by = lambda up, down, else_: F.when(sent == "positive", up).when(sent == "negative", down).otherwise(else_)
    # fixed values: the output sentences
    urgent = F.when(sent == "negative", "Immediate portfolio review required").otherwise("Monitor for compliance impact")
    track = by("Supports efficacy dossiers and marketing claims", "Flag for regulatory risk assessment", "Track for market and formulation implications")
    impact = by("Positive evidence for claims substantiation", "Adverse signal requiring compliance monitoring", "Track for VMS regulatory implications")
    title = F.regexp_replace(F.substring(F.coalesce(blank_to_null("title"), kind), 1, 55), r"\s+\S*$", "")
    on = F.concat(label, F.lit(": "), kind)
    return (
        F.when(~is_generic(raw), raw)
        .when(F.lower(F.coalesce("severity", F.lit(""))) == "high", F.concat(on, F.when(name != "", F.concat(F.lit(" on "), name)).otherwise(""), F.lit(" — "), urgent))
        .when(name != "", F.concat(on, F.lit(" on "), name, F.lit(" — "), track))
        .otherwise(F.concat(label, F.lit(": "), title, F.lit(" — "), impact))
    )
