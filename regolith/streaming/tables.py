"""Streaming into versioned tables: idempotent ingest with incremental enrichment, and a cache whose
entries expire by event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.store import insert_or_ignore, missing, update
from ..operators.versioned import KeyedTable

Enrich = Callable[[DataFrame], DataFrame]


def enriched(rows: DataFrame, column: str, key: str, enrich: Enrich) -> DataFrame:
    """``rows`` with answers of ``enrich`` for those whose ``column`` is blank; it sees no others, and
    blank answers change nothing.  ``enrich`` gives (key, column)."""
    answers = enrich(missing(rows, column)).select(key, column).where(F.coalesce(F.col(column), F.lit("")) != "")
    return update(rows, answers, key)


def apply_batch(table: KeyedTable, batch: DataFrame, name: str, column: str, enrich: Enrich, order: str = "rec_no") -> int:
    """One step: new keys of ``batch`` go in, then blank values of the touched buckets are filled."""
    return table.step(name, batch, lambda old, new: enriched(insert_or_ignore(old, new, table.key, order), column, table.key, enrich))


def ingest_enriched(rows: DataFrame, table: KeyedTable, column: str, enrich: Enrich, checkpoint: str, order: str = "rec_no") -> StreamingQuery:
    """Each micro-batch is one committed step by its id: a batch that is run again changes nothing, and only
    buckets with new rows are read and written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_batch(table, batch, f"batch-{batch_id}", column, enrich, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Cache(StatefulProcessor):
    """The newest entry of a key, until event time passes its age."""

    def __init__(self, days: int):
        self.ttl = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(int(t.value // 1_000_000) for p in rows for t in p["cached_at"])
        had = self.entry.get()[0] if self.entry.exists() else None
        if had is not None and had >= newest:
            return
        if had is not None:
            self.handle.deleteTimer(had + self.ttl)
        if newest + self.ttl <= timerValues.getCurrentWatermarkInMs():  # too old to be kept at all
            self.entry.clear()
            yield _event(key, newest, "expired")
            return
        self.entry.update((newest,))
        self.handle.registerTimer(newest + self.ttl)
        yield _event(key, newest, "cached")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = self.entry.get()[0]
        self.entry.clear()
        yield _event(key, at, "expired")

    def close(self) -> None:
        pass


def _event(key: Any, at: int, what: str) -> pd.DataFrame:
    return pd.DataFrame({"key": [key[0]], "cached_at": [pd.Timestamp(at, unit="ms", tz="UTC")], "event": [what]})


def cache_events(entries: DataFrame, days: int = 30, delay: str = "0 seconds") -> DataFrame:
    """(key, cached_at, event) of a stream of (key, cached_at): ``cached`` as an entry comes in or is replaced by a
    newer one, ``expired`` once the watermark is ``days`` whole days beyond it.  State holds one number
    a live key.  Needs the RocksDB state store, which this sets for the session."""
    spark = entries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = entries.select("key", F.col("cached_at").cast("timestamp").alias("cached_at")).withWatermark("cached_at", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(days), outputStructType="key string, cached_at timestamp, event string", outputMode="Append", timeMode="EventTime")
