"""Model answers kept by content, so that no prompt is asked twice, and budgets without a global sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrich import stub_client
from .versioned import KeyedTable

#: A client gets the prompt and its hash, which a service can use to recognise a repeated call.
Client = Callable[[str, str], str]


def plain_stub(prompt: str, _: str) -> str:
    return stub_client(prompt)


def within_budget(rows: DataFrame, budget: int, tier: str = "tier", key: str = "id", most: int = 10_000) -> DataFrame:
    """The first ``budget`` rows by tier, then key, then nothing else: rows of equal tier and key are alike.

    Counts of tiers say which go in whole.  In the tier where the budget ends, counts of ever longer key
    prefixes do the same, until at most ``most`` rows share the last prefix; only these are sorted."""
    if budget <= 0:
        return rows.where("false")
    counts = {r[0]: r[1] for r in rows.where(F.col(tier).isNotNull()).groupBy(tier).count().collect()}  # a few tiers
    left, whole, edge = budget, [], None
    for t in sorted(counts):
        if counts[t] > left:
            edge = t
            break
        whole.append(t)
        left -= counts[t]
    taken = rows.where(F.col(tier).isin(whole))
    if edge is None or not left:
        return taken
    rest, n, size = rows.where(F.col(tier) == edge), counts[edge], 0
    while n > most:
        size += 2
        prefix = F.substring(F.coalesce(key, F.lit("")), 1, size)
        at = None
        for r in sorted(rest.groupBy(prefix.alias("p")).count().collect()):  # one more pair of characters each round
            if r[1] > left:
                at, n = r[0], r[1]
                break
            left -= r[1]
        taken = taken.unionByName(rest.where(prefix < at))
        rest = rest.where(prefix == at)
        if not left:
            return taken
        if len(at) < size:  # whole keys: the rest are equal
            break
    return taken.unionByName(rest.orderBy(key).limit(left))


class AnswerBook:
    """Answers by the hash of variant and prompt, in a keyed table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.table = KeyedTable(spark, root, "hash string, variant string, answer string", "hash", buckets)

    @staticmethod
    def hash(variant: Column, prompt: Column) -> Column:
        return F.sha2(F.concat_ws("\0", variant, prompt), 256)

    def learn(self, prompts: DataFrame, client: Client = plain_stub) -> int:
        """Ask for each distinct (variant, prompt) that the book lacks; the number of calls.

        Answers are written before they count, and a call that came that far is never made again; a task
        that is lost before asks again under the same hash."""
        spark = prompts.sparkSession
        new = prompts.where(F.col("prompt").isNotNull()).select(self.hash(F.col("variant"), F.col("prompt")).alias("hash"), "variant", "prompt")
        new = new.dropDuplicates(["hash"]).join(self.table.read().select("hash"), "hash", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"hash": b["hash"], "variant": b["variant"], "answer": [client(p, h) for p, h in zip(b["prompt"], b["hash"], strict=True)]})

        path = self.table.manifest.fresh("asked")
        new.mapInPandas(run, "hash string, variant string, answer string").write.parquet(path)
        asked = spark.read.schema(self.table.schema).parquet(path)
        n = asked.count()
        if n:
            self.table.step(path, asked, lambda old, rows: old.unionByName(rows.join(old.select("hash"), "hash", "left_anti")))
        return n

    def answers(self, rows: DataFrame, key: str, variants: Mapping[str, Column]) -> DataFrame:
        """(key, variant, answer) of rows under each variant's prompt; null where the book has none."""
        asked = prompts_of(rows, variants, key)
        hashed = asked.withColumn("hash", self.hash(F.col("variant"), F.col("prompt")))
        return hashed.join(self.table.read().select("hash", "answer"), "hash", "left").select(key, "variant", "answer")


def prompts_of(rows: DataFrame, variants: Mapping[str, Column], *keys: str) -> DataFrame:
    """(keys, variant, prompt) of every row under every variant, from one pass over the rows."""
    each = F.array(*[F.struct(F.lit(v).alias("variant"), p.alias("prompt")) for v, p in variants.items()])
    return rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.variant", "x.prompt")


def instructions(texts: Mapping[str, str], *columns: str) -> dict[str, Column]:
    """Prompts: a variant's instruction, then the filled columns, a line each."""
    body = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns]
    return {v: reduce(lambda a, b: F.concat_ws("\n", a, b), body, F.lit(t)) for v, t in texts.items()}
