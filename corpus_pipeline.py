"""A training-corpus pipeline: quality, line dedup, near copies, benchmark leaks, packing.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame``.  All but the last return the columns
of ``documents``; the last returns the placed pieces.  ``run`` writes each stage's rows to
the shared folder and reads them again, so that a lost executor costs one stage at most.
An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.decontamination import decontaminate
from regolith.llm.line_dedup import without_boilerplate
from regolith.llm.ngram_join import keep_one
from regolith.llm.packing import packing
from regolith.llm.quality_classifier import fit_quality, keep_quality
from regolith.llm.queries import remainder, table
from regolith.llm.textkit import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the documents and labels given.

    Null and empty texts are scored as empty texts; rows are judged one by one, so repeated rows and
    null ids stay or go alike; without a positive label all rows stay; columns pass through as they are."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return keep_quality(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; no row goes, ``n_chars`` follows the text.

    A null text stays null and keeps its ``n_chars``; blank lines stay; the smallest id keeps a line, a
    null id counts as the largest; columns are found by exact name, so others may differ in case alone."""
    out = without_boilerplate(docs)
    if "n_chars" not in docs.columns:
        return out
    names = docs.columns
    rows = out.toDF(*[f"_c{i}" for i in range(len(names))])
    text, size = (f"_c{names.index(c)}" for c in ("text", "n_chars"))
    kind = dict(docs.toDF(*[f"_c{i}" for i in range(len(names))]).dtypes)[size]
    return rows.withColumn(size, F.coalesce(F.length(text).cast(kind), F.col(size))).toDF(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Null and blank texts link with nothing and stay; a row without an id counts after all ids and goes
    if its text is near one with an id; rows of one id stay or go together."""
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and blank texts hold none; rows of one id, and rows without an id, are judged together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    A null or empty text is its closing id alone; rows of equal or null ids are packed each."""
    path = public_tokenizers.path
    return packing(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontamination", leaks),
    ("best_fit_packing", pack),
]

#: Model fitting, graph components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialize(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
