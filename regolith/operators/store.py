"""Keyed tables of signals, feedback and enrichment results.

Writes are whole-table expressions: each function returns the table's next state, which the
caller writes; nothing is updated in place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facets import keep_first


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's checkpoint folder, which all executors share.

    Without that setting a local session gets a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="regolith-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(rows: DataFrame, name: str) -> str:
    """Write rows to a fresh shared path; the path."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def insert_new(table: DataFrame, rows: DataFrame, key: str = "source_id", order: str = "rec_no") -> DataFrame:
    """Rows to append: new keys only, the first row of each; columns the table lacks go."""
    fresh = keep_first(rows.join(table.select(key), key, "left_anti"), F.col(key), F.col(order))
    return fresh.select(*[c for c in table.columns if c in fresh.columns])


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str = "source_id", order: str = "rec_no") -> DataFrame:
    return table.unionByName(insert_new(table, rows, key, order), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str = "source_id") -> DataFrame:
    """The table with the columns of ``changes`` overwritten where its key occurs there."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_hit"))
    out = table.join(new, key, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def coalesce_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Like :func:`update`, but null values of ``changes`` leave the table's as they are."""
    names = [c for c in changes.columns if c != key]
    out = table.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def missing(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.coalesce(F.col(column), F.lit("")) == "")


def unseen(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key).distinct(), key, "left_anti")


def corrections(feedback: DataFrame, signals: DataFrame, k: int = 20) -> DataFrame:
    """Newest feedback that corrects something, with the signal it is about."""
    rows = feedback.where("rating in ('incorrect', 'partially_correct') and coalesce(correction_note, '') <> ''")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(k).join(signals, "source_id", "left")


def accuracy(feedback: DataFrame) -> DataFrame:
    """Counts of ratings; zero, not null, over an empty table."""
    return feedback.agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == r).alias(r) for r in ("correct", "incorrect", "partially_correct")])


def fresh_cache(cache: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Cache entries whose age in whole days is under ``days``; parts of a second count."""
    return cache.where(F.col("cached_at").cast("timestamp_ntz") > F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def unsent(table: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rows not yet sent of the last ``hours`` hours, high severity first, then by time."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    rows = table.where(~F.coalesce("digest_sent", F.lit(False)) & (F.col("scraped_at") >= cut))
    return rows.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "scraped_at", "source_id")


def mark_sent(table: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """The table with the flag of rows whose key is among ``ids`` set."""
    hit = ids.select(F.col(key).alias("_id")).distinct().withColumn("_hit", F.lit(True))
    out = table.join(hit, table[key] == hit["_id"], "left")
    return out.withColumn("digest_sent", F.coalesce("_hit", "digest_sent", F.lit(False))).drop("_id", "_hit")
