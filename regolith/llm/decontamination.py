"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in DataFrame functions.

Method
------
1. A window of a document has the length of a benchmark item and starts at any word; one that
   reaches over an end of the document is cut there.  Its elements are its ``k``-word shingles
   numbered by occurrence, so that the Jaccard of element sets is the weighted Jaccard of
   shingles (sum of smaller over sum of larger counts).
2. A window enters only where enough of its shingles stand in *some* item of its length: a
   running sum over the document's places in the vocabulary of that length.  This is lossless
   and knows no item.  Between two places where the sum changes nothing changes but the
   cut at the document's ends, so only the windows at both are taken.
3. Windows and items get 128-bit SimHash fingerprints: each bit is the majority of its
   elements' hash bits.  An index of 16 blocks of 8 bits finds every fingerprint within ``RADIUS``
   = 47: among 16 blocks one differs in two bits at most, so items enter each block under its 37
   values within two bits and windows under their own.  A pair counts in its first such block.
4. Candidates are verified by the exact intersection of their elements.

At the threshold 0.75 two fingerprints differ in 22 bits on average with a deviation of
4.3, so a pair beyond the radius is a matter of one in 10^8; tests compare with all windows.

The benchmark is shuffled to nobody: its vocabulary and its index are broadcast if their
counted rows are at most ``broadcast_limit`` and joined by shuffle otherwise.

Texts compare in lower-case A-Z.  Items under ``k`` words are one shingle of all their words,
equal to a window or not: they are compared as such.

Defined results: null or blank texts and items match nothing; a null id is reported as null; rows with
equal id and text give one result; equal items are reported each; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import lower_ascii, window_hashes, words
from .textkit import materialize, required, without_ids

BROADCAST_LIMIT = 500_000
BLOCKS, BLOCK_BITS = 16, 8
NEAR = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= 2]
RADIUS = BLOCKS * 3 - 1
_LAST = (1 << 63) - 1
_LANES = (1 << 32) | 1


def _shingled(d: DataFrame, k: int) -> DataFrame:
    """Adds ``w`` (lower-case words) and ``h`` (shingle hashes)."""
    return d.withColumn("w", words(lower_ascii(F.coalesce("text", F.lit(""))))).withColumn("h", window_hashes("w", k))


def _lane_sums() -> list[Column]:
    """Partial sums of the elements' hash bits, two 32-bit counters a column."""
    return [F.expr(f"sum(shiftrightunsigned({h}, {j}) & {_LANES}L) as c{i}_{j}") for i, h in enumerate(("e", "xxhash64(e, 1)")) for j in range(32)]


def _majority(i: int) -> Column:
    """Half ``i`` of the fingerprint: bits that more than half of ``size`` elements have."""
    low = [(f"(c{i}_{j} & 4294967295L)", j) for j in range(32)]
    high = [(f"shiftrightunsigned(c{i}_{j}, 32)", j + 32) for j in range(32)]
    return F.expr(" | ".join(f"if({n} * 2 > size, shiftleft(1L, {j}), 0L)" for n, j in low + high))


def fingerprints(shingles: DataFrame, *key: str) -> DataFrame:
    """(key, e, size, f0, f1): elements and SimHash of each key's multiset of shingles ``s``."""
    own = shingles.groupBy(*key, "s").agg(F.count("*").cast("int").alias("c"))
    own = own.select(*key, "s", F.explode(F.sequence(F.lit(1), "c")).alias("o")).select(*key, F.xxhash64("s", "o").alias("e"))
    sums = own.groupBy(*key).agg(F.collect_list("e").alias("es"), F.count("*").cast("int").alias("size"), *_lane_sums())
    return sums.select(*key, F.col("es").alias("e"), "size", _majority(0).alias("f0"), _majority(1).alias("f1"))


def _block(b: int, halves: tuple[str, str]) -> str:
    return f"cast(shiftrightunsigned({halves[b // 8]}, {b % 8 * BLOCK_BITS}) & 255 as int)"


def _blocks(halves: tuple[str, str]) -> Column:
    """A row (b, v) for each block of a fingerprint."""
    return F.expr(f"inline(array({', '.join(f'struct({b} as b, {_block(b, halves)} as v)' for b in range(BLOCKS))}))")


def candidates(windows: DataFrame, items: DataFrame, send: bool) -> DataFrame:
    """Windows and items of one length whose fingerprints are within the radius, each pair once."""
    by = items.select("total", "item_id", F.col("e").alias("ie"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    by = by.select("*", _blocks(("g0", "g1"))).withColumn("v", F.expr(f"explode(transform(array({', '.join(map(str, NEAR))}), x -> v ^ x))"))
    own = windows.select("*", _blocks(("f0", "f1")))
    both = own.join(F.broadcast(by) if send else by, ["total", "b", "v"])
    first = ", ".join(f"if(bit_count({_block(b, ('(f0 ^ g0)', '(f1 ^ g1)'))}) <= 2, {b}, null)" for b in range(BLOCKS))
    return both.where(f"bit_count(f0 ^ g0) + bit_count(f1 ^ g1) <= {RADIUS} and coalesce({first}) = b")


def _windows(places: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, th, total, at): starts of the windows that may reach the threshold, from each
    document's places ``p`` in the vocabulary of length ``total``; starts may lie before the text."""
    key = ["doc_id", "th", "m", "total"]
    at = places.select(*key, F.explode("p").alias("p"))
    at = at.select(*key, F.explode(F.array(F.struct((F.col("p") - F.col("total") + 1).alias("at"), F.lit(1).alias("c")), F.struct((F.col("p") + 1).alias("at"), F.lit(-1).alias("c")))).alias("x"))
    at = at.groupBy(*key, F.col("x.at").alias("at")).agg(F.sum("x.c").alias("c"))
    order = Window.partitionBy(*key).orderBy("at")
    at = at.select(*key, "at", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(order).alias("next")).where("n > 0")
    at = at.select(*key, "n", F.explode(F.array_distinct(F.array("at", F.col("next") - 1))).alias("at"))
    size = F.least(F.col("at") + F.col("total"), "m") - F.greatest("at", F.lit(0))
    return at.where(F.col("n") * (1 + threshold) >= (size + F.col("total")) * threshold - 1e-9).select("doc_id", "th", "total", "at")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, k: int = 5, broadcast_limit: int = BROADCAST_LIMIT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each document and
    item whose similarity reaches the threshold, the earliest of equals."""
    items = required(benchmark, item_col, item_text_col).toDF("item_id", "text")
    items = _shingled(items, k).withColumn("n", F.size("w")).where("n > 0").select("item_id", "n", F.xxhash64("w").alias("ih"), "h").dropDuplicates(["item_id", "ih"])
    shingles = items.where(f"n >= {k}").select("item_id", "ih", (F.col("n") - (k - 1)).alias("total"), F.explode("h").alias("s"))
    prints = materialize(fingerprints(shingles, "item_id", "ih", "total"), "items")
    vocabulary = shingles.select("s", "total").distinct()
    tiny = items.where(f"n < {k}").select("item_id", "n", F.col("ih").alias("s"))
    # bounded sides: counted before they are sent
    small = vocabulary.count() + tiny.count() <= broadcast_limit
    send = prints.count() * BLOCKS * len(NEAR) <= broadcast_limit

    # outer generators: else a size check on the array would be pushed below and compute it twice
    d = required(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")
    # rows with equal id differ by the hash of their shingles
    hashed = _shingled(d, k)
    keyed = hashed.select("doc_id", F.xxhash64("h").alias("th"), F.size("h").alias("m"), F.posexplode_outer("h").alias("pos", "s"))
    hits = keyed.join(F.broadcast(vocabulary) if small else vocabulary, "s")
    places = hits.groupBy("doc_id", "th", "m", "total").agg(F.array_distinct(F.collect_list("pos")).alias("p"))  # an equal row has the same places
    wins = materialize(_windows(places.where(F.size("p") >= F.col("total") * threshold - 1e-9), threshold), "windows")
    # the few documents with windows are read again; Spark sends their ids if the stored table is small
    again = _shingled(d.join(wins.select("doc_id").distinct(), "doc_id", "left_semi"), k).select("doc_id", F.xxhash64("h").alias("th"), "h").dropDuplicates(["doc_id", "th"])
    cut = F.slice("h", F.greatest("at", F.lit(0)) + 1, F.least(F.col("at") + F.col("total"), F.size("h")) - F.greatest("at", F.lit(0)))
    key = ["doc_id", "th", "total", "at"]
    rows = again.join(wins, ["doc_id", "th"]).select(*key, F.explode(cut).alias("s"))
    near = candidates(fingerprints(rows, *key), prints, send)
    common = F.size(F.array_intersect("e", "ie"))
    scored = near.select("doc_id", "item_id", F.greatest("at", F.lit(0)).alias("start_word"), (F.col("size") + k - 1).cast("long").alias("n_words"), (common / (F.col("size") + F.col("total") - common)).alias("similarity"))

    sizes = [r.n for r in tiny.select("n").distinct().collect()]  # at most k - 1 values
    for m in sizes:
        t = tiny.where(f"n = {m}")
        t = F.broadcast(t) if small else t
        runs = hashed.select("doc_id", F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.xxhash64(F.slice("w", i + 1, m)))).alias("g"))  # noqa: B023
        found = runs.select("doc_id", F.posexplode_outer("g").alias("start_word", "s")).join(t, "s")
        scored = scored.unionByName(found.select("doc_id", "item_id", "start_word", F.lit(m).cast("long").alias("n_words"), F.lit(1.0).alias("similarity")))

    best = scored.where(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("m"), "n_words")).alias("b"))
    return best.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "item_id", (-F.col("b.m")).cast("long").alias("start_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark item; rows with a null id are judged together."""
    found = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return without_ids(docs, options.get("id_col", "doc_id"), found)
