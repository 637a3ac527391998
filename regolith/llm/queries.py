"""The registered queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontamination import contaminated
from .language_id import language_id
from .line_dedup import line_dedup
from .lm_scoring import lm_scoring
from .ngram_join import ngram_join
from .packing import packing
from .quality_classifier import fit_quality, score_quality
from .quality_rules import quality_rules
from .sql import SQL
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .warc import read_warc, write_warc
from .whitening import fit_whitening, identity_error, valid_vectors, whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("cleaned", "left_share")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return score_quality(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(table(spark, sf_dir, "documents"), remainder(3) != 1)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring(table(spark, sf_dir, "documents"), remainder(10) == 0)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    x = rows.withColumn("vector", F.transform("vector", lambda c: F.floor(c.cast("double") * 64) + F.lit(1_000_000)))
    model = fit_whitening(x, 32)
    head = F.col("id").alias("vec_id")
    if model is None:
        kinds = (("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
        return x.where("false").select(head, *[F.lit(None).cast(t).alias(c) for c, t in kinds])
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums])
    off = F.zip_with("vector", sums, lambda v, s: v * F.lit(model.n).cast("long") - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda total, v: total + v * v)
    error = identity_error(x, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    out = whitened(x, model).select(head, deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_ngram_join, op2_quality_rules, op3_best_fit_packing, op4_quality_classifier, op5_language_id,
        op6_warc, op7_decontamination, op8_substring_dedup, op9_line_dedup, op10_lm_scoring,
        op11_phrase_collocations, op12_suffix_dedup, op13_embedding_whitening,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
