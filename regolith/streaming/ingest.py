"""Structured Streaming forms of ingest and rolling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import norm_key
from ..operators.store import insert_new


def event_time(rows: DataFrame, column: str = "scraped_at") -> DataFrame:
    """Watermarks need a timestamp with zone; captured tables carry one without."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def distinct_notices(rows: DataFrame, delay: str = "1 day", key: str = "source_id") -> DataFrame:
    """The first row of each key within the watermark; state is dropped after ``delay``."""
    return event_time(rows).withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark([key])


def rolling_counts(rows: DataFrame, delay: str = "1 day", length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Counts per ingredient and sliding window; append mode emits closed windows alone."""
    r = event_time(rows).withColumn("ingredient", norm_key("ingredient_name")).where("ingredient is not null")
    g = r.withWatermark("scraped_at", delay).groupBy(F.window("scraped_at", length, step), "ingredient").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "ingredient", "n")


def ingest(rows: DataFrame, path: str, checkpoint: str, key: str = "source_id", order: str = "rec_no") -> StreamingQuery:
    """Append new keys of each micro-batch to the Parquet table at ``path``.

    A batch that is run again finds its keys in the table and appends nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        table = batch.sparkSession.read.schema(batch.schema).parquet(path)
        insert_new(table, batch, key, order).write.mode("append").parquet(path)

    rows.sparkSession.createDataFrame([], rows.schema).write.mode("ignore").parquet(path)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
