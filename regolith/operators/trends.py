"""Ingredient trends over signals; every function takes the instant that counts as now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import norm_key


def since(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")


def recent(signals: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days, without an upper bound."""
    return signals.where(F.col("scraped_at") >= since(as_of, days))


def rolling_counts(signals: DataFrame, as_of: str) -> DataFrame:
    """(ingredient, count_7d, count_30d)."""
    rows = recent(signals, as_of).select(norm_key("ingredient_name").alias("ingredient"), "scraped_at").where("ingredient is not null")
    return rows.groupBy("ingredient").agg(F.count_if(F.col("scraped_at") >= since(as_of, 7)).alias("count_7d"), F.count("*").alias("count_30d"))


def spikes(signals: DataFrame, as_of: str, least: int = 2, ratio: float = 2.0) -> DataFrame:
    """Ingredients whose week exceeds ``ratio`` times the month's weekly mean, steepest first."""
    c = rolling_counts(signals, as_of).withColumn("spike_ratio", F.col("count_7d") * 30.0 / (F.col("count_30d") * 7.0))
    return c.where((F.col("count_30d") >= least) & (F.col("count_7d") * 30 > ratio * 7 * F.col("count_30d"))).orderBy(F.desc("spike_ratio"), "ingredient")


def _middle(rows: DataFrame) -> DataFrame:
    """(middle): the row at position ``total // 2`` in (time, rec_no) order, in three steps of exact
    counts: its day, its second, its rank within that second.  No range partitions, nothing sampled."""
    rows = rows.select("scraped_at", "rec_no", F.date_trunc("day", "scraped_at").alias("day"), F.date_trunc("second", "scraped_at").alias("second"))

    def holding(counts: DataFrame, unit: str, base: Column, mid: Column) -> DataFrame:
        before = F.sum("n").over(Window.orderBy(unit)) - F.col("n") + base
        return counts.withColumn("start", before).withColumn("mid", mid).where("start <= mid and mid < start + n").select(unit, "start", "mid")

    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    day = F.broadcast(holding(days, "day", F.lit(0), F.floor(F.sum("n").over(Window.partitionBy()) / 2)))
    seconds = rows.join(day, "day").groupBy("second").agg(F.count("*").alias("n"), F.first("start").alias("base"), F.first("mid").alias("m"))
    second = F.broadcast(holding(seconds, "second", F.col("base"), F.col("m")))
    k = F.row_number().over(Window.partitionBy("second").orderBy("scraped_at", "rec_no")) - 1
    ranked = rows.join(second, "second").withColumn("k", k)
    return ranked.where("start + k = mid").select(F.struct("scraped_at", "rec_no").alias("middle"))


def claim_shift(signals: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Ingredients whose dominant type differs between the earlier and later half of all rows.

    The halves meet at the row midpoint in (time, rec_no) order; a tie within a half goes to
    the type seen first.  A shift to a safety concern from efficacy or other is notable."""
    rows = recent(signals, as_of).select(norm_key("ingredient_name").alias("ingredient"), F.coalesce(F.nullif("signal_type", F.lit("")), F.nullif("event_type", F.lit("")), F.lit("other")).alias("type"), "scraped_at", "rec_no")
    at = F.struct("scraped_at", "rec_no")
    half = rows.join(F.broadcast(_middle(rows)), F.lit(True), "left")  # one row
    half = half.withColumn("late", at >= F.col("middle")).withColumn("pos", at).where("ingredient is not null")
    by_type = half.groupBy("ingredient", "late", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = by_type.groupBy("ingredient", "late").agg(F.sum("n").alias("total"), F.min_by("type", F.struct((-F.col("n")).alias("n"), "first")).alias("type"), F.max("n").alias("n"))
    out = top.groupBy("ingredient").agg(
        F.sum("total").alias("total"),
        *[F.max(F.when(F.col("late") == late, F.col(c))).alias(f"{side}_{c}") for side, late in (("from", False), ("to", True)) for c in ("type", "n")],
    )
    notable = (F.col("to_type") == "safety_concern") & F.col("from_type").isin("efficacy_claim", "other")
    return out.where(F.col("total") >= least).where("from_type <> to_type").where(notable | ((F.col("from_n") >= 2) & (F.col("to_n") >= 2))).select("ingredient", "from_type", "to_type", "from_n", "to_n", "total")


def week_over_week(rows: DataFrame, key: Column, as_of: str, top: int | None = 6) -> DataFrame:
    """(key, curr, prev, change) of keys seen this week, by change then volume."""
    ts = F.col("scraped_at")
    r = rows.where(ts >= since(as_of, 14)).select(key.alias("key"), (ts >= since(as_of, 7)).alias("now")).where("key is not null")
    out = r.groupBy("key").agg(F.count_if("now").alias("curr"), F.count_if(~F.col("now")).alias("prev")).where("curr > 0")
    out = out.withColumn("change", F.col("curr") - F.col("prev")).orderBy(F.desc("change"), F.desc("curr"), "key")
    return out.limit(top) if top else out


def trend_class(counts: DataFrame) -> DataFrame:
    """Adds ``trend``: a change of over 30 % of the current count either way, else stable."""
    return counts.withColumn("trend", F.when(F.col("change") * 10 > 3 * F.col("curr"), "rising").when(F.col("change") * 10 < -3 * F.col("curr"), "declining").otherwise("stable"))


def sentiment(signals: DataFrame, as_of: str, least: int = 2, drop: float = -0.3) -> DataFrame:
    """Confidence-weighted sentiment per ingredient for 30 days, the last 14 and those before.

    A missing or zero confidence weighs 0.5; an empty side takes the month's score."""
    s = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", -1.0).otherwise(0.0)
    w = F.when(F.coalesce("sentiment_confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("sentiment_confidence"))
    rows = recent(signals, as_of).where("coalesce(sentiment, '') <> ''")
    rows = rows.select(norm_key("ingredient_name").alias("ingredient"), s.alias("s"), w.alias("w"), (F.col("scraped_at") >= since(as_of, 14)).alias("late")).where("ingredient is not null")
    mean = lambda cond: F.try_divide(F.sum(F.when(cond, F.col("s") * F.col("w"))), F.sum(F.when(cond, F.col("w"))))
    out = rows.groupBy("ingredient").agg(F.count("*").alias("n"), mean(F.lit(True)).alias("score_30d"), mean(F.col("late")).alias("late"), mean(~F.col("late")).alias("early"))
    out = out.where(F.col("n") >= least).select("ingredient", "n", "score_30d", F.coalesce("late", "score_30d").alias("score_14d"), F.coalesce("early", "score_30d").alias("score_prior"))
    return out.withColumn("shift", F.col("score_14d") - F.col("score_prior")).withColumn("rising_risk", F.col("shift") < drop)


def sentiment_distribution(signals: DataFrame, as_of: str) -> DataFrame:
    return recent(signals, as_of).where("coalesce(sentiment, '') <> ''").groupBy("sentiment").agg(F.count("*").alias("n"))


def rolling_windows(signals: DataFrame) -> DataFrame:
    """Counts per ingredient in 30-day windows that start every day: days are counted before each
    count goes to its 30 windows."""
    rows = signals.select(F.date_trunc("day", "scraped_at").cast("timestamp_ntz").alias("day"), norm_key("ingredient_name").alias("ingredient")).where("ingredient is not null")
    days = rows.groupBy("day", "ingredient").agg(F.count("*").alias("n"))
    wide = days.select(F.explode(F.expr("sequence(day - interval 29 days, day, interval 1 day)")).alias("start"), "ingredient", "n")
    return wide.groupBy("start", "ingredient").agg(F.sum("n").alias("n"))
