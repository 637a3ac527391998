"""Tables that change in whole steps: files first, then one pointer file that makes them count.

A writer puts rows into fresh folders with Spark's own writers, which work on any store.  They count
only when the manifest has a row for them, and a step's manifest rows are one small file, which a store shows
whole or not at all.  A writer that dies before that leaves files that nothing refers to; one that runs
a committed step again finds it there.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import accuracy_line

_ROWS = "version long, step string, part string, path string"
_FILES = 4  # of a bucket, so that no bucket is one task


class Manifest:
    """Rows (version, step, part, path) of the committed steps below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], _ROWS).write.mode("ignore").json(f"{self.root}/manifest")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).json(f"{self.root}/manifest")

    def last(self) -> int:
        return self.rows().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def has(self, step: str) -> bool:
        return not self.rows().where(F.col("step") == step).isEmpty()

    def parts(self, version: int) -> dict[str, str]:
        return {r.part: r.path for r in self.rows().where(F.col("version") == version).collect()}

    def fresh(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def commit(self, version: int, step: str, parts: Mapping[str, str]) -> None:
        rows = [(version, step, k, v) for k, v in parts.items()] or [(version, step, "", "")]
        self.spark.createDataFrame(rows, _ROWS).coalesce(1).write.mode("append").json(f"{self.root}/manifest")


class KeyedTable:
    """A table of one row a key in ``buckets`` key buckets; a step rewrites those it touches.

    A version's manifest names the folder of every bucket, so readers see one version whole, and a
    step reads and writes only buckets that its rows fall into."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, buckets: int = 64):
        self.manifest = Manifest(spark, root)
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def folders(self, parts: Mapping[str, str]) -> DataFrame:
        paths = [p for p in parts.values() if p]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self.folders(self.manifest.parts(self.manifest.last() if version is None else version))

    def step(self, name: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commit ``change(old, rows)``, where ``old`` are the table's rows in the buckets of ``rows``; the version.

        A committed name changes nothing again.  ``change`` keeps to the keys of its two tables."""
        last = self.manifest.last()
        if self.manifest.has(name):
            return last
        touched = {str(r.b) for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets``
        parts = {k: v for k, v in self.manifest.parts(last).items() if v}
        old = self.folders({k: v for k, v in parts.items() if k in touched})
        out = change(old, rows).select(*self.schema.names, self.bucket().alias("_bucket"))
        path = self.manifest.fresh("data")
        spread = F.pmod(F.xxhash64(self.key) / self.buckets, F.lit(_FILES)).cast("int")
        out.repartition("_bucket", spread).write.partitionBy("_bucket").parquet(path)
        whole = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        written = self.spark.read.schema(whole).parquet(path).select("_bucket").distinct().collect()
        parts = {k: v for k, v in parts.items() if k not in touched} | {str(r[0]): f"{path}/_bucket={r[0]}" for r in written}
        self.manifest.commit(last + 1, name, parts)
        return last + 1


class Log:
    """Appended steps of several forms of the same rows, which appear together."""

    def __init__(self, spark: SparkSession, root: str):
        self.manifest = Manifest(spark, root)

    def append(self, step: str, forms: Mapping[str, Callable[[str], None]]) -> None:
        """``forms`` write the step's rows to the folder they get; nothing counts before all are there."""
        if self.manifest.has(step):
            return
        paths = {}
        for name, write in forms.items():
            paths[name] = self.manifest.fresh(name)
            write(paths[name])
        self.manifest.commit(self.manifest.last() + 1, step, paths)

    def paths(self, form: str) -> list[str]:
        return [r.path for r in self.manifest.rows().where(F.col("part") == form).orderBy("version").collect()]


class FeedbackLog(Log):
    """Feedback as a table and its JSON mirror; accuracy figures as CSV with one header a file."""

    def feedback(self, step: str, rows: DataFrame) -> None:
        self.append(f"feedback-{step}", {"table": rows.write.parquet, "mirror": rows.write.json})

    def accuracy(self, step: str, counts: DataFrame, as_of: str) -> None:
        self.append(f"accuracy-{step}", {"accuracy": accuracy_line(counts, as_of).coalesce(1).write.option("header", True).csv})

    def table(self, schema: str) -> DataFrame:
        return self._read("table", schema, lambda r, p: r.parquet(*p))

    def mirror(self, schema: str) -> DataFrame:
        return self._read("mirror", schema, lambda r, p: r.json(p))

    def figures(self) -> DataFrame:
        return self._read("accuracy", "at string, total long, correct long, incorrect long, partially_correct long, pct double", lambda r, p: r.option("header", True).csv(p))

    def _read(self, form: str, schema: str, read) -> DataFrame:
        spark, paths = self.manifest.spark, self.paths(form)
        return read(spark.read.schema(schema), paths) if paths else spark.createDataFrame([], schema)


class CitationStore(Log):
    """The citation store in its three forms: partitioned JSON, a flat copy, and the page with the data inline."""

    def publish(self, step: str, rows: DataFrame, page: str, marker: str, most: int = 10_000) -> None:
        """``marker`` in the page's text is replaced by the newest ``most`` rows as one JSON array, a bounded page."""
        head = rows.orderBy(F.desc_nulls_last("date"), "id").limit(most)
        line = head.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), F.struct(*rows.columns).alias("x")))), lambda r: r["x"])).alias("data"))
        # inside a script element a closing tag would end it
        text = line.select(F.replace(F.lit(page), F.lit(marker), F.replace("data", F.lit("</"), F.lit("<\\/"))).alias("value"))
        self.append(step, {
            "partitioned": rows.repartition("authority").write.partitionBy("authority").json, "flat": rows.write.json,
            "page": text.coalesce(1).write.option("lineSep", "\n").text,
        })

    def newest(self, form: str) -> str | None:
        paths = self.paths(form)
        return paths[-1] if paths else None
