"""Writers of stores, feedback, reports and their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_feedback(rows: DataFrame, table_path: str, json_path: str) -> None:
    """Append feedback to its table and to the JSON mirror."""
    rows.write.mode("append").parquet(table_path)
    rows.write.mode("append").json(json_path)


def accuracy_line(counts: DataFrame, as_of: str) -> DataFrame:
    """Accuracy counts with their instant and a percentage of one decimal."""
    pct = F.round(F.try_divide(100.0 * F.col("correct"), F.col("total")), 1)
    return counts.select(F.lit(as_of).alias("at"), "total", "correct", "incorrect", "partially_correct", pct.alias("pct"))


def append_accuracy(counts: DataFrame, path: str, as_of: str) -> None:
    """Append a line of accuracy counts as CSV."""
    accuracy_line(counts, as_of).write.mode("append").option("header", True).csv(path)


def write_citations(rows: DataFrame, path: str) -> None:
    """The citation store as JSON lines, partitioned by authority for pruned reads."""
    rows.repartition("authority").write.mode("overwrite").partitionBy("authority").json(path)


def merge_sample(corpus: DataFrame, processed: DataFrame, key: str = "id") -> DataFrame:
    """The corpus with processed rows in place of their originals."""
    return corpus.join(processed.select(key), key, "left_anti").unionByName(processed, allowMissingColumns=True)


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, fingerprint) of a table, whatever its order and partitioning: sums of two row
    hashes and the count, digested."""
    cols = sorted(rows.columns)
    h = rows.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(11), *cols).cast("decimal(38,0)").alias("b"))
    s = h.agg(F.count("*").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return s.select("rows", F.sha2(F.concat_ws("|", "rows", "a", "b"), 256).alias("fingerprint"))


def data_block(signals: DataFrame, citations: DataFrame) -> DataFrame:
    """One row of counts and fingerprints for the page that embeds the data."""
    s, c = fingerprint(signals), fingerprint(citations)
    return s.toDF("signals", "signals_fingerprint").join(F.broadcast(c.toDF("citations", "citations_fingerprint")))
