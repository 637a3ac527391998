"""Phrase collocation mining by dynamic itemset counting.

Method
------
The documents are dealt round robin to ``shards`` stored parts, which are scanned in a cycle, one
Spark job a scan.  Every scan counts phrases of all lengths at once:

* words count from the first scan on;
* a longer phrase starts to count in the first scan after both its subphrases (without its last and
  without its first word) have reached the threshold, by the counts so far;
* a phrase is complete when it was counted through one full cycle, each shard once.

At most ``longest`` cycles are needed.  Counts are appended to a table bucketed by phrase hash, so that
sums over all scans so far need no exchange.  Which subphrases have reached the threshold is told to
tasks as one byte a hash slot: the scan from which it holds.  A slot is set once and never changes, so
that a phrase's start, the later of its subphrases' slots, is the same in every scan and its count is
exact; slots shared by chance only start phrases that need not be counted.  The table of slots has a
fixed size, at most ``MAX_SLOTS`` bytes; where a corpus fills it, more is counted, nothing lost.

A last cycle finds the words of phrases over the threshold: each shard is asked for those that no earlier
shard has named.  Scores, containment and ranks are joins and aggregates over these.

A task sends a phrase once a unit of ``UNIT`` words, so a frequent phrase costs its bucket a row a
unit; ranks are taken within salts first.  64-bit hashes stand for phrases: a collision would change
one count with probability below 1e-3 per 100 million phrases.

Defined results: null texts count as empty; a null language is ``und``; texts without words, empty
tables and pieces shorter than a phrase give nothing; repeated rows count each; texts may be of any
length, a text's words take some 60 bytes each while its batch is read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import U64, Words, bound_batches, estimated_bytes, flat, materialize, mix, power_of_two, required, shared_dir, shuffle_partitions, windows

UNIT = 1 << 22
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 26
_NEVER = 255
_SALTS = 64
_BITS = 32768  # of one row of Spark's bitmap functions

_TEXT = np.arange(256, dtype=np.uint8)
_TEXT[65:91] += 32
_TEXT[list(b".,;:!?")] = 10
_BREAK = np.zeros(256, dtype=bool)
_BREAK[10:14] = True


def _language(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def keys(h: np.ndarray, n: int, language: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, in one language; of no words: of the language."""
    seed = U64((language + n * 0x9E3779B97F4A7C15) % (1 << 64))
    return mix(windows(h, n) ^ seed) if n else mix(np.array([seed], dtype=U64))


def _within(h: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` words from each place on are of one piece."""
    m = max(0, len(h) - n + 1)
    ok = np.ones(m, dtype=bool)
    for j in range(n):
        ok &= h[j : j + m] != 0
    return ok


class Tokens:
    """Word hashes of texts, a 0 after every piece; ``at`` has each hash's word (-1: none)."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        self.data = _TEXT[data]
        self.words = Words(self.data, offsets)
        h = self.words.hashes(lower=False)
        h[h == 0] = 1
        n = len(h)
        if n:
            breaks = np.cumsum(_BREAK[self.data], dtype=np.int64)[self.words.starts]
            ends = breaks[1:] != breaks[:-1]
            first = self.words.first[1:-1]
            ends[first[(first > 0) & (first < n)] - 1] = True
            cut = np.flatnonzero(np.append(ends, True)) + 1
            self.h, self.at = np.insert(h, cut, U64(0)), np.insert(np.arange(n), cut, -1)
        else:
            self.h, self.at = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Tokens]]:
    lang = np.array(batch.column("lang").to_pylist(), dtype=object)
    for x in dict.fromkeys(lang):
        yield x, Tokens(batch.column("text").take(pa.array(np.flatnonzero(lang == x))))


def _rows(h: np.ndarray, n: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, dtype=np.int32)), pa.array(f.astype(np.int64))], ["h", "words", "f"])


def _scan(t: int, shards: int, longest: int, slots: Broadcast):
    """(h, words, f): counts of a unit's phrases that are active in scan ``t``."""

    def unit(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        since = slots.value
        mask = U64(len(since) - 1)
        for lang, parts in held.items():
            h, code = np.concatenate(parts), _language(lang)
            if t < shards:
                yield _rows(keys(h, 0, code), 0, np.array([np.count_nonzero(h)]))
            shorter = None
            for n in range(1, longest + 1):
                own = keys(h, n, code)
                ok = _within(h, n)
                if n > 1:
                    start = since[(shorter & mask).astype(np.int64)].astype(np.int16)
                    start = np.maximum(start[:-1], start[1:])
                    ok &= (start <= t) & (t < start + shards)
                if n > 1 or t < shards:
                    u, f = np.unique(own[ok], return_counts=True)
                    for a in range(0, len(u), 1 << 18):
                        yield _rows(u[a : a + (1 << 18)], n, f[a : a + (1 << 18)])
                shorter = own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for lang, tokens in _by_language(b):
                held.setdefault(lang, []).append(tokens.h)
                size += len(tokens.h)
            if size >= UNIT:
                yield from unit(held)
                held, size = {}, 0
        yield from unit(held)

    return run


def _name(longest: int, wanted: Broadcast):
    """(h, lang, phrase, firsts, rests, inner) of phrases whose slot is wanted, once a task or so:
    hashes of the two parts of every cut, and of all shorter phrases of two words and more inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        mask, seen = U64(len(bits) - 1), set()
        for b in batches:
            for lang, tokens in _by_language(b):
                code, w = _language(lang), tokens.words
                raw, h = tokens.data.tobytes(), tokens.h
                own = {n: keys(h, n, code) for n in range(1, longest + 1)}
                for n in range(2, longest + 1):
                    hit = np.flatnonzero(_within(h, n) & bits[(own[n] & mask).astype(np.int64)])
                    u, first = np.unique(own[n][hit], return_index=True)
                    new = [i for i, x in enumerate(u.tolist()) if x not in seen]
                    if not new:
                        continue
                    seen.update(u[new].tolist())
                    p = hit[first[new]]
                    s, e = w.starts[tokens.at[p]].tolist(), w.ends[tokens.at[p + n - 1]].tolist()
                    phrases = [b" ".join(raw[x:y].split()).decode() for x, y in zip(s, e, strict=True)]
                    hashes = lambda cols, size: pa.array(list(np.stack(cols, axis=1).view(np.int64)) if cols else [[]] * size, pa.list_(pa.int64()))
                    firsts = [own[k][p] for k in range(1, n)]
                    rests = [own[n - k][p + k] for k in range(1, n)]
                    inner = [own[k][p + j] for k in range(2, n) for j in range(n - k + 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u[new].view(np.int64)), pa.array([lang] * len(p)), pa.array(phrases), hashes(firsts, len(p)), hashes(rests, len(p)), hashes(inner, len(p)), pa.array(np.full(len(p), keys(h, 0, code).view(np.int64)[0]))],
                        ["h", "lang", "phrase", "firsts", "rests", "inner", "whole"],
                    )
                if len(seen) > 1 << 20:
                    seen.clear()

    return run


def _slots_of(found: DataFrame, slots: int) -> np.ndarray:
    """One bit a slot that some hash of ``found`` has: at most ``slots / _BITS`` rows come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit(slots - 1)) + 1
    rows = found.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(slots, _BITS), dtype=bool)
    for r in rows.toLocalIterator():
        out[(r.part - 1) * _BITS : r.part * _BITS] = np.unpackbits(np.frombuffer(bytes(r.bits), dtype=np.uint8), bitorder="little")
    return out[:slots]


def _exact(name: str, digits: int) -> Column:
    return F.col(name).cast(f"decimal({digits},0)")


def ranked(named: DataFrame, freq: DataFrame, contained_percent: int, top: int) -> DataFrame:
    """Score, drop contained phrases, rank within each language."""
    cuts = named.select("h", "f", F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "x")).select("h", "f", "cut", F.col("x.firsts").alias("lh"), F.col("x.rests").alias("rh"))
    part = lambda h, f: freq.select(F.col("h").alias(h), F.col("f").alias(f))
    cuts = cuts.join(part("lh", "l"), "lh").join(part("rh", "r"), "rh")
    # decimals of 13 digits: products stay below 38, and div truncates exactly
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(f as decimal(13,0)) * cast(f as decimal(13,0)))) div (cast(l as decimal(13,0)) * cast(r as decimal(13,0)))")
    best = cuts.groupBy("h").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    longer = named.select(F.explode("inner").alias("h"), F.col("f").alias("g")).groupBy("h").agg(F.max("g").alias("g"))
    rows = named.join(longer, "h", "left").where(F.col("g").isNull() | (_exact("g", 20) * 100 < _exact("f", 20) * contained_percent)).join(best, "h")
    rows = rows.join(part("whole", "n"), "whole").select("h", "lang", "phrase", F.col("f").alias("a"), "s.l", "s.r", "n", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(_SALTS))).orderBy(*order))).where(F.col("rank") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, contained_percent: int = 50, shards: int = 4, slots: int | None = None, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words
    found ``least`` times or more.  ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its
    lowest-scoring cut, ``n`` the language's words, ``score`` floor(1000000 * a * a / (l * r)); phrases inside a
    longer one with at least ``contained_percent`` of their count are dropped."""
    if not 2 <= longest <= 8 or not 1 <= shards <= 30:
        raise ValueError("longest is 2 to 8 words, shards are 1 to 30")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = required(docs, lang_col, text_col).toDF("lang", "text")
    slots = slots or min(MAX_SLOTS, max(MIN_SLOTS, power_of_two(estimated_bytes(docs) / 64)))
    if slots & (slots - 1):
        raise ValueError("slots is a power of two")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    path = shared_dir(spark, "shards")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)

    counts, buckets = f"phrase_counts_{uuid.uuid4().hex}", shuffle_partitions(spark)
    since = np.full(slots, _NEVER, dtype=np.uint8)
    place = shared_dir(spark, "phrase-counts")
    t, last = 0, shards - 1
    try:
        while t <= last:
            sent = spark.sparkContext.broadcast(since)
            found = dealt.where(F.col("shard") == t % shards).select("lang", "text").mapInArrow(_scan(t, shards, longest, sent), "h long, words int, f long")
            found = found.repartition(buckets, "h").groupBy("h").agg(F.max("words").alias("words"), F.sum("f").alias("f"))
            found.write.format("parquet").mode("append").bucketBy(buckets, "h").option("path", place).option("compression", "zstd").saveAsTable(counts)
            sent.destroy()
            t += 1
            if t > (longest - 1) * shards:  # all subphrases are complete
                continue
            subphrases = spark.table(counts).where(F.col("words").between(1, longest - 1))
            if t >= shards:  # words are complete
                subphrases = subphrases.where((F.col("words") > 1) | F.lit(t == shards))
            reached = _slots_of(subphrases.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least), slots)
            new = reached & (since == _NEVER)
            if new.any():
                since[new] = t
                last = t + shards - 1
        total = spark.table(counts).groupBy("h").agg(F.max("words").alias("words"), F.sum("f").alias("f"))
        freq = materialize(total.where((F.col("f") >= least) | (F.col("words") == 0)), "phrase-totals")
    finally:
        spark.sql(f"drop table if exists {counts}")

    open_, named = freq.where("words >= 2").select("h", "f"), []
    for s in range(shards):
        wanted = _slots_of(open_, slots)
        if not wanted.any():
            break
        sent = spark.sparkContext.broadcast(wanted)
        rows = dealt.where(F.col("shard") == s).select("lang", "text").mapInArrow(_name(longest, sent), "h long, lang string, phrase string, firsts array<long>, rests array<long>, inner array<long>, whole long")
        rows = rows.groupBy("h").agg(F.min(F.struct("lang", "phrase", "firsts", "rests", "inner", "whole")).alias("x"))
        named.append(materialize(rows.join(open_, "h").select("h", "f", "x.*"), "phrases"))
        sent.destroy()
        open_ = materialize(open_.join(named[-1].select("h"), "h", "left_anti"), "unnamed")
    if not named:
        kinds = (("lang", "string"), ("rank", "long"), ("phrase", "string"), ("a", "long"), ("l", "long"), ("r", "long"), ("n", "long"), ("score", "long"))
        return freq.where("false").select(*[F.lit(None).cast(k).alias(c) for c, k in kinds])
    every = named[0]
    for x in named[1:]:
        every = every.unionByName(x)
    return ranked(every, freq, contained_percent, top)
