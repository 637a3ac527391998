"""Ninety-day ingredient report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.expr import any_of, first_match


def report_severity(text: Column, kind: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, R.REPORT_HIGH), "high")
        .when(kind.isin("ban", "recall") & any_of(low, ["class i", "serious", "life"]), "high")
        .when(kind.isin("warning_letter", "GMP_violation", "recall"), "medium")
        .when(any_of(low, R.REPORT_LOW), "low")
        .otherwise("medium")
    )


def report_category(text: Column) -> Column:
    return first_match(F.lower(text), R.REPORT_CATEGORY, "")


def ingredient_table(c: DataFrame, as_of: str, authorities: tuple[str, ...] = ("TGA", "FDA", "EFSA", "EMA"), k: int | None = 20) -> DataFrame:
    """Counts per ingredient and authority, and the trend of daily rates (30 days against 60)."""
    late = F.coalesce(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), 30), F.lit(False))
    g = c.where("ingredient <> 'Unknown'").groupBy("ingredient").agg(
        *[F.count_if(F.col("authority") == a).alias(a.lower()) for a in authorities], F.count("*").alias("total"), F.count_if(late).alias("recent"), F.count_if(~late).alias("earlier"), F.count_distinct("authority").alias("jurisdictions"), F.max("date").alias("last_date")
    )
    # r/30 against 1.5 or 0.5 times e/60, in whole numbers
    trend = F.when(F.col("earlier") == 0, F.when(F.col("recent") > 0, "↑").otherwise("—")).when(F.col("recent") * 4 >= F.col("earlier") * 3, "↑").when(F.col("recent") * 4 <= F.col("earlier"), "↓").otherwise("→")
    out = g.withColumn("trend", trend).withColumn("multi_jurisdiction", F.col("jurisdictions") >= 2).drop("jurisdictions").orderBy(F.desc("total"), "ingredient")
    return out.limit(k) if k else out


def trending(table: DataFrame) -> DataFrame:
    return table.where("trend = '↑' and (recent >= 2 or total >= 3)")


def low_activity(table: DataFrame, k: int = 10) -> DataFrame:
    """Cited twice or more before, not in the last 30 days; latest first."""
    return table.where("recent = 0 and earlier >= 2").select("ingredient", "last_date").orderBy(F.desc_nulls_last("last_date"), "ingredient").limit(k)


def executive(c: DataFrame) -> DataFrame:
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "high").alias("high"), F.count_distinct("authority").alias("authorities"))


def company_targets(c: DataFrame) -> DataFrame:
    """Companies with warning letters and the ids of their records, newest first."""
    rows = c.where("source_type = 'warning_letter' and coalesce(company, '') <> ''")
    return rows.groupBy("company").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.datediff(F.lit("2200-01-01"), "date"), F.lit(10**6)).alias("k"), "id"))), lambda x: x["id"]).alias("ids"))
