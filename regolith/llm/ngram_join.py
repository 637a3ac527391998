"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Method
------
A document's set holds the 64-bit hashes of its distinct ``k``-word shingles.

1. *Survivors.*  One pass over the texts sends the smallest-hash prefix of each set,
   pre-aggregated per chunk, to hash buckets.  Any document with a partner at the
   threshold shares at least ``need`` prefix elements with others; all others leave here.
   Equal sets collapse to their smallest id.
2. *Tiles.*  Sets are ordered by document frequency, rarest first.  A pair at the
   threshold must share an element of both overlap prefixes, and their sizes fall in the
   same or adjacent size bands, so each survivor enters the tiles (element, band) of its
   prefix.  All links come from tiles: bitmap signatures whose bit counts bound the overlap
   from above reject most pairs, then sorted arrays are intersected exactly.
3. *Hubs.*  A tile's hub is the member whose elements are the most frequent.  Each member is
   first compared with the strongest hub of its tiles, then with all hubs of tiles that still hold
   several components.  This links big groups of near copies through few pivots.
4. *Rest.*  Tiles whose members are then all one component are dropped by aggregation; in the
   others all pairs of different components that pass the bounds on size, on the elements left
   behind the shared one, and on bits are intersected.  Large tiles split into blocks that meet
   pairwise.

Hubs only shorten the rest, which is a lossless filter, so every link between different sets is
either found or joins two documents already connected through verified links.

Defined results: null text, empty text or no words give an empty set, linked with nothing;
fewer than ``k`` words give one shingle; every row is returned; of rows with one id that with
the largest set counts (then the larger fingerprint); a null id counts as larger than all others
and rows without one differ by their texts (ids below 2^62 are assumed); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textkit import (
    bound_batches,
    U64,
    Words,
    by_bucket,
    chunk_count,
    estimated_bytes,
    flat,
    fold,
    materialize,
    mix,
    pieces,
    power_of_two,
    required,
    windows,
)

BLOCK = 256
TILE_BUCKETS = 64


def ceil_of(threshold: Fraction, n: int) -> int:
    return -(-threshold.numerator * n // threshold.denominator)


def bands(threshold: Fraction, limit: int = 1 << 40) -> list[int]:
    """Lower bounds of size bands; partners at the threshold are at most one band apart."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * threshold.denominator // threshold.numerator + 1)
    return out


def shingle_sets(words: Words, h: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    win = windows(h, k)
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= k:
            yield np.unique(win[a : b - k + 1])
        elif b > a:
            yield np.array([fold(h[a:b])], dtype=U64)
        else:
            yield np.zeros(0, dtype=U64)


_SURVEY = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("body", pa.binary()), ("solo", pa.binary())])


def _survey(threshold: Fraction, k: int, buckets: int):
    """Chunks to (a) one row of per-document figures, (b) one blob of prefix elements per bucket.

    A chunk sends each distinct element once: with its document if one document of the
    chunk has it, else with none, as those documents are counted on the spot.
    """

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in pieces(off, 4 << 20):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                h = words.hashes(lower=True)
                n = np.zeros(b - a, dtype=np.int64)
                fp = np.zeros((2, b - a), dtype=U64)
                toks, owner = [], []
                for d, s in enumerate(shingle_sets(words, h, k)):
                    n[d] = m = len(s)
                    if m:
                        fp[0, d], fp[1, d] = s.sum(dtype=U64), np.bitwise_xor.reduce(mix(s * U64(0x9FB21C651E98DF25)))
                        pre = m - ceil_of(threshold, m) + max(1, m // 10)
                        toks.append(s[:pre])
                        owner.append(np.full(min(pre, m), d, dtype=np.uint32))
                tok = np.concatenate(toks) if toks else np.zeros(0, dtype=U64)
                own = np.concatenate(owner) if owner else np.zeros(0, dtype=np.uint32)
                order = np.argsort(tok, kind="stable")
                tok, own = tok[order], own[order]
                head = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, dtype=np.int64)
                size = np.diff(np.concatenate((head, [len(tok)])))
                inside = np.bincount(own[np.repeat(size > 1, size)], minlength=b - a)
                tok, own = tok[head], np.where(size > 1, np.uint32(0xFFFFFFFF), own[head])
                yield pa.record_batch(
                    [
                        pa.array([-1 - int(tok[0] % U64(1 << 20)) if len(tok) else -1], pa.int32()),
                        pa.array([ids[a:b].astype(np.int64).tobytes()], pa.binary()),
                        pa.array([np.stack((n, inside)).astype(np.int64).tobytes()], pa.binary()),
                        pa.array([fp.tobytes()], pa.binary()),
                    ],
                    schema=_SURVEY,
                )
                order, at = by_bucket((tok & U64(buckets - 1)).astype(np.uint32), buckets)
                tok, own = tok[order], own[order]
                rows = [i for i in range(buckets) if at[i + 1] > at[i]]
                uniq = [np.unique(own[at[i] : at[i + 1]], return_inverse=True) for i in rows]
                docs = ids[a:b].astype(np.int64)
                sent_ids, sent_own = [], []
                for who, inv in uniq:  # local numbers of at most 16 bits where they fit; 0 is "no single document"
                    none = len(who) and who[-1] == 0xFFFFFFFF
                    real = who[:-1] if none else who
                    sent_ids.append(docs[real].tobytes())
                    sent_own.append(np.where(inv < len(real), inv + 1, 0).astype(np.uint32 if len(real) > 65000 else np.uint16).tobytes())
                if rows:
                    yield pa.record_batch(
                        [
                            pa.array(rows, pa.int32()),
                            pa.array(sent_ids, pa.binary()),
                            pa.array([tok[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()),
                            pa.array(sent_own, pa.binary()),
                        ],
                        schema=_SURVEY,
                    )

    return run


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("shared", pa.int64())])
_COUNTED_SQL = "doc_id long, n long, fa long, fb long, shared long"


def _count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket: how many of each document's prefix elements some other chunk has too."""
    empty = _COUNTED.empty_table()
    if not table.num_rows:
        return empty
    ids, body, solo = (table.column(c).to_pylist() for c in ("ids", "body", "solo"))
    if key[0].as_py() < 0:
        out = []
        for i, x, f in zip(ids, body, solo, strict=True):
            n, inside = np.frombuffer(x, dtype=np.int64).reshape(2, -1)
            fa, fb = np.frombuffer(f, dtype=np.int64).reshape(2, -1)
            out.append(pa.Table.from_arrays([pa.array(v) for v in (np.frombuffer(i, dtype=np.int64), n, fa, fb, inside)], schema=_COUNTED))
        return pa.concat_tables(out)
    tok = np.concatenate([np.frombuffer(x, dtype=U64) for x in body])
    doc, real = [], []
    for i, x, s in zip(ids, body, solo, strict=True):
        m = len(x) // 8
        local = np.frombuffer(s, dtype=np.uint16 if len(s) == 2 * m else np.uint32).astype(np.int64)
        names = np.concatenate((np.zeros(1, dtype=np.int64), np.frombuffer(i, dtype=np.int64)))
        doc.append(names[local])
        real.append(local > 0)
    doc, real = np.concatenate(doc), np.concatenate(real)
    order = np.argsort(tok)
    tok = tok[order]
    same = np.zeros(len(tok) + 1, dtype=bool)
    same[1:-1] = tok[1:] == tok[:-1]
    hit = doc[order][(same[1:] | same[:-1]) & real[order]]
    who, n = np.unique(hit, return_counts=True)
    nothing = pa.nulls(len(who), pa.int64())
    return pa.Table.from_arrays([pa.array(who), nothing, nothing, nothing, pa.array(n.astype(np.int64))], schema=_COUNTED)


def survey(docs: DataFrame, threshold: Fraction, k: int) -> DataFrame:
    """(doc_id, n, fa, fb, shared) per document: set size, 128-bit set fingerprint, and the
    number of prefix elements that other documents' prefixes hold too."""
    buckets = power_of_two(max(32, 2 * estimated_bytes(docs) // (8 << 20)))
    blobs = docs.mapInArrow(_survey(threshold, k, buckets), "bucket int, ids binary, body binary, solo binary")
    rows = blobs.groupBy("bucket").applyInArrow(_count, _COUNTED_SQL)
    figures = F.when(F.col("n").isNotNull(), F.struct("n", "fa", "fb"))
    return rows.groupBy("doc_id").agg(F.max(figures).alias("f"), F.sum("shared").alias("shared")).select("doc_id", "f.*", "shared")


def _arrays(k: int):
    """Texts to (doc_id, n, set fingerprint, tokens)."""

    def run(batches):
        for batch in batches:
            data, off = flat(batch.column(1))
            ids = batch.column(0)
            for a, b in pieces(off, 4 << 20):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                sets = list(shingle_sets(words, words.hashes(lower=True), k))
                fa = np.array([s.sum(dtype=U64) for s in sets], dtype=U64).view(np.int64)
                fb = np.array([np.bitwise_xor.reduce(mix(s * U64(0x9FB21C651E98DF25))) for s in sets], dtype=U64).view(np.int64)
                yield pa.record_batch(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fa), pa.array(fb), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n", "fa", "fb", "tokens"],
                )

    return run


def signature(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap of a set as 64-bit words."""
    at = (tokens >> U64(20)) & U64(bits - 1)
    full = np.zeros(bits, dtype=np.uint8)
    full[at.astype(np.int64)] = 1
    return np.packbits(full).view(U64)


def _verify(threshold: Fraction):
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), dtype=U64), np.frombuffer(right[i].as_buffer(), dtype=U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, arrays: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the distinct pairs (a, b) whose exact Jaccard reaches the threshold."""
    x = arrays.select(F.col("doc_id").alias("a"), F.col("tokens").alias("xa"))
    y = arrays.select(F.col("doc_id").alias("b"), F.col("tokens").alias("xb"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb")
    return both.mapInArrow(_verify(threshold), "a long, b long")


def _chunk_elements(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("tok", pa.binary()), ("cnt", pa.binary())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        tok, cnt = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), dtype=U64) for x in table.column("tokens")]), return_counts=True)
        order, at = by_bucket((tok & U64(buckets - 1)).astype(np.uint32), buckets)
        tok, cnt = tok[order], cnt[order].astype(np.uint32)
        rows = [i for i in range(buckets) if at[i + 1] > at[i]]
        return pa.Table.from_arrays(
            [pa.array(rows, pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([tok[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary()), pa.array([cnt[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())],
            schema=schema,
        )

    return run


def _frequency(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket: elements of two documents or more, sent back to the chunks that have them."""
    schema = pa.schema([("chunk", pa.int32()), ("tok", pa.binary()), ("cnt", pa.binary())])
    if not table.num_rows:
        return schema.empty_table()
    toks = [np.frombuffer(x.as_buffer(), dtype=U64) for x in table.column("tok")]
    tok = np.concatenate(toks)
    uniq, inv = np.unique(tok, return_inverse=True)
    total = np.zeros(len(uniq), dtype=np.int64)
    np.add.at(total, inv, np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("cnt")]))
    df = np.minimum(total[inv], 0xFFFFFFFF).astype(np.uint32)
    at, out_t, out_c = 0, [], []
    for t in toks:
        d = df[at : at + len(t)]
        out_t.append(t[d > 1].tobytes())
        out_c.append(d[d > 1].tobytes())
        at += len(t)
    return pa.Table.from_arrays([table.column("chunk").combine_chunks().cast(pa.int32()), pa.array(out_t, pa.binary()), pa.array(out_c, pa.binary())], schema=schema)


_TILE = pa.schema([("tok", pa.int64()), ("band", pa.int32()), ("home", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int32()), ("rest", pa.int32()), ("weight", pa.int64())])
_TILE_SQL = "tok long, band int, home boolean, doc_id long, n int, rest int, weight long"


def _prefixes(threshold: Fraction):
    edges = np.array(bands(threshold))

    def run(key: tuple[pa.Scalar, ...], members: pa.Table, back: pa.Table) -> pa.Table:
        if not members.num_rows or not back.num_rows:
            return _TILE.empty_table()
        tok = np.concatenate([np.frombuffer(x.as_buffer(), dtype=U64) for x in back.column("tok")])
        df = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in back.column("cnt")])
        order = np.argsort(tok)
        tok, df = tok[order], df[order]
        if not len(tok):
            return _TILE.empty_table()
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for doc, n, raw in zip(members.column("doc_id").to_pylist(), members.column("n").to_pylist(), members.column("tokens"), strict=True):
            mine = np.frombuffer(raw.as_buffer(), dtype=U64)
            at = np.searchsorted(tok, mine)
            at[at == len(tok)] = 0
            shared = tok[at] == mine
            mine, freq = mine[shared], df[at[shared]]
            least = ceil_of(threshold, n)
            if len(mine) < least:
                continue
            pick = mine[np.lexsort((mine, freq))][: len(mine) - least + 1]
            band = int(np.searchsorted(edges, n, side="right")) - 1
            m, weight = len(pick), int(1000 * freq.sum(dtype=np.int64) / n)
            rest = len(mine) - np.arange(m)  # shared elements from this one on
            for to, home in ((band, True), (band + 1, False)):
                for c, v in zip(cols, (pick.view(np.int64), np.full(m, to), np.full(m, home), np.full(m, doc), np.full(m, n), rest, np.full(m, weight)), strict=True):
                    c.append(v)
        if not cols[0]:
            return _TILE.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)).cast(t.type) for c, t in zip(cols, _TILE, strict=True)], schema=_TILE)

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile_pairs(threshold: Fraction):
    """A bucket of tile blocks: pairs of different components that pass size and bitmap bounds."""
    num, den = threshold.numerator, threshold.denominator

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _PAIR.empty_table()
        tok, band, one, two, part, doc, comp = (table.column(c).to_numpy() for c in ("tok", "band", "x", "y", "part", "doc_id", "comp"))
        n, rest = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "rest"))
        home = np.array(table.column("home").to_pylist(), dtype=bool)
        sigs = [x.as_buffer() for x in table.column("sig")]
        order = np.lexsort((doc, two, one, band, tok))
        tile = np.stack((tok[order], band[order].astype(np.int64), one[order].astype(np.int64), two[order].astype(np.int64)))
        cut = np.flatnonzero(np.concatenate(([True], (tile[:, 1:] != tile[:, :-1]).any(axis=0), [True])))
        left, right = [], []
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            at = order[s:e]
            if e - s < 2 or (comp[at] == comp[at[0]]).all():
                continue
            bits = np.stack([np.frombuffer(sigs[i], dtype=U64) for i in at])
            ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            crossing = one[at[0]] != two[at[0]]
            for i in range(e - s):
                p = at[i]
                q = np.arange(e - s) if crossing and part[p] == one[p] else np.arange(i + 1, e - s) if not crossing else None
                if q is None:
                    continue
                w = at[q]
                ok = (comp[w] != comp[p]) & (home[w] | home[p])
                if crossing:
                    ok &= part[w] != part[p]
                lo, hi = np.minimum(n[w], n[p]), np.maximum(n[w], n[p])
                ok &= den * lo >= num * hi
                # at the first element that two prefixes share, the overlap is at most what is left behind it
                ok &= (den + num) * np.minimum(rest[w], rest[p]) >= num * (n[w] + n[p])
                q, w = q[ok], w[ok]
                if not len(q):
                    continue
                common = np.bitwise_count(bits[q] & bits[i]).sum(axis=1, dtype=np.int64)
                # bits of one side that the other lacks are elements outside the overlap
                most = np.minimum(n[w] - (ones[q] - common), n[p] - (ones[i] - common))
                w = w[den * most >= num * (n[w] + n[p] - most)]
                if len(w):
                    left.append(np.minimum(doc[w], doc[p]))
                    right.append(np.maximum(doc[w], doc[p]))
        if not left:
            return _PAIR.empty_table()
        pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
        return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR)

    return run


def _signatures(threshold: Fraction):
    edges = bands(threshold)

    def run(batches):
        for batch in batches:
            toks = [np.frombuffer(x.as_buffer(), dtype=U64) for x in batch.column(1)]
            out = {"doc_id": [], "band": [], "sig": []}
            for doc, t in zip(batch.column(0).to_pylist(), toks, strict=True):
                band = int(np.searchsorted(edges, len(t), side="right")) - 1
                for to in (band, band + 1):
                    bits = min(1 << 16, max(512, power_of_two(12 * edges[to])))
                    out["doc_id"].append(doc)
                    out["band"].append(to)
                    out["sig"].append(signature(t, bits).tobytes())
            yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["band"], pa.int32()), pa.array(out["sig"], pa.binary())], names=list(out))

    return run


def _bound(threshold: Fraction):
    """Pairs whose bit counts allow the threshold."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches):
        for batch in batches:
            n = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=U64) for c in (4, 5))
                both = int(np.bitwise_count(x & y).sum(dtype=np.int64))
                most = min(n[0][i] - int(np.bitwise_count(x).sum(dtype=np.int64)) + both, n[1][i] - int(np.bitwise_count(y).sum(dtype=np.int64)) + both)
                keep.append(den * most >= num * (n[0][i] + n[1][i] - most))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def bounded(pairs: DataFrame, sigs: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b, band, na, nb) that the bitmaps of their band leave, once each."""
    x = sigs.select(F.col("doc_id").alias("a"), "band", F.col("sig").alias("sa"))
    y = sigs.select(F.col("doc_id").alias("b"), "band", F.col("sig").alias("sb"))
    both = pairs.join(x, ["a", "band"]).join(y, ["b", "band"]).select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_bound(threshold), "a long, b long").distinct()


_CROWD = ["tok", "band"]


def mixed_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of two components or more that a pair can meet in: their size and hub."""
    # the member whose elements are the most frequent stands closest to what the others copy
    hub = F.max(F.struct("weight", (-F.col("doc_id")).alias("m"), "n", "comp")).alias("hub")
    return tiles.groupBy(*_CROWD).agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("home").alias("h"), hub).where("c0 <> c1 and h")


def hub_pairs(tiles: DataFrame, threshold: Fraction, strongest: bool) -> DataFrame:
    """(a, b, band, na, nb): members and hubs of their tiles, or each member's strongest hub alone."""
    hubs = mixed_tiles(tiles).select(*_CROWD, F.col("hub.n").alias("nb"), F.col("hub.comp").alias("hc"), (-F.col("hub.m")).alias("b"), F.col("hub.weight").alias("hw"))
    near = tiles.join(hubs, _CROWD).where(f"comp <> hc and {threshold.denominator} * least(n, nb) >= {threshold.numerator} * greatest(n, nb)")
    near = near.withColumnRenamed("doc_id", "a")
    if strongest:
        best = near.groupBy("a").agg(F.max(F.struct("hw", (-F.col("b")).alias("m"), "band", "n", "nb")).alias("x"))
        return best.select("a", (-F.col("x.m")).alias("b"), F.col("x.band").alias("band"), F.col("x.n").alias("na"), F.col("x.nb").alias("nb"))
    return near.groupBy("a", "b").agg(F.min("band").alias("band"), F.first("n").alias("na"), F.first("nb").alias("nb"))


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component of their ``doc_id``, itself where it has none."""
    return rows.drop("comp").join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def rest_pairs(tiles: DataFrame, sigs: DataFrame, threshold: Fraction, spread: int) -> DataFrame:
    """Pairs of different components in mixed tiles that pass all bounds, once each."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = tiles.join(mixed_tiles(tiles).select(*_CROWD, parts.alias("parts")), _CROWD)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("x", F.least("part", "o")).withColumn("y", F.greatest("part", "o")).drop("o", "parts", "weight")
    placed = placed.join(sigs, ["doc_id", "band"])
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("tok", "band", "x", "y"), F.lit(spread)).cast("int"))
    return placed.groupBy("bucket").applyInArrow(_tile_pairs(threshold), "a long, b long").distinct()


_NO_ID = 1 << 62


def _shift(ids: Column, table: DataFrame) -> tuple[bool, int]:
    """Whether rows lack an id, and what is then taken from ids so that they stay below ``_NO_ID``: 0 unless
    there are ids from there on.  Nodes are longs, so such tables may not hold ids below ``-_NO_ID`` as well."""
    r = table.agg(F.count_if(ids.isNull()).alias("none"), F.min(ids).alias("low"), F.max(ids).alias("high")).first()
    if not r.none or r.high is None or r.high < _NO_ID:
        return r.none > 0, 0
    if r.low < -_NO_ID:
        raise ValueError("a table with null ids spans 2^63 ids or more")
    return True, _NO_ID


def _node(id_col: str, text_col: str, shift: int) -> Column:
    """The id, shifted, or for rows without one a number above all ids that tells texts apart."""
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).bitwiseAND(F.lit(_NO_ID - 1)).bitwiseOR(F.lit(_NO_ID))
    return F.coalesce(F.col(f"`{id_col}`").cast("long") - F.lit(shift), own)


def ngram_join(docs: DataFrame, threshold: float = 0.75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): set size, smallest id with the same set,
    and smallest id reachable over links of Jaccard ``>= threshold``; a row for each of ``docs``."""
    rows = required(docs, id_col, text_col).toDF("doc_id", "text")
    lacking, shift = _shift(F.col("doc_id").cast("long"), rows)
    rows = rows.select(_node("doc_id", "text", shift).alias("doc_id"), "text")
    out = rows.select("doc_id").join(_components(rows, Fraction(threshold).limit_denominator(1000), k), "doc_id")
    if not lacking:
        return out.select("doc_id", "n_shingles", "class_id", "component_id")
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c) + F.lit(shift)).alias(c)
    return out.select(known("doc_id"), "n_shingles", known("class_id"), known("component_id"))


def _components(docs: DataFrame, t: Fraction, k: int) -> DataFrame:
    bound_batches(docs.sparkSession)
    counted = materialize(survey(docs, t, k), "survey")
    key = [F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("fa", "fb")]
    classes = counted.select("doc_id", "n", *key, "shared")
    firsts = classes.groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("class_id"))
    # the same bound for a partner as small as the threshold allows
    need = f"greatest(1, cast(floor(cast(ceil(n * {t.numerator} / {t.denominator}) as long) / 10) as long))"
    alive = classes.where(f"n > 0 and shared >= {need}").join(firsts, ["n", "fa", "fb"], "left_semi")
    reps = firsts.where("n > 0").select(F.col("class_id").alias("doc_id"))
    alive = alive.join(reps, "doc_id", "left_semi").select("doc_id", "n", "fa", "fb")
    arrays = docs.join(alive.select("doc_id"), "doc_id", "left_semi").mapInArrow(_arrays(k), "doc_id long, n long, fa long, fb long, tokens binary")
    arrays = arrays.join(alive, ["doc_id", "n", "fa", "fb"], "left_semi").dropDuplicates(["doc_id"])
    arrays = materialize(arrays.select("doc_id", "n", "tokens"), "arrays")

    chunks = max(4, -(-arrays.count() // 2000))
    dealt = arrays.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    buckets = power_of_two(max(16, chunks))
    sent = dealt.groupBy("chunk").applyInArrow(_chunk_elements(buckets), "bucket int, chunk int, tok binary, cnt binary")
    back = sent.groupBy("bucket").applyInArrow(_frequency, "chunk int, tok binary, cnt binary")
    tiles = materialize(dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_prefixes(t), _TILE_SQL), "tiles")
    sigs = arrays.select("doc_id", "tokens").mapInArrow(_signatures(t), "doc_id long, band int, sig binary")

    own = tiles.withColumn("comp", F.col("doc_id"))
    label = None
    for strongest in (True, False):
        edges = materialize(verified(bounded(hub_pairs(own, t, strongest), sigs, t), arrays, t), "hubs")
        label = connected_components(edges if label is None else edges.union(label.select("node", "component")))
        own = materialize(labelled(tiles, label), "tiles")
    late = materialize(verified(rest_pairs(own, sigs, t, power_of_two(max(TILE_BUCKETS, chunks * 4))), arrays, t), "rest")
    # the links that are left join components, which are fewer than documents
    ends = labelled(labelled(late.withColumnRenamed("a", "doc_id"), label).select(F.col("comp").alias("ra"), F.col("b").alias("doc_id")), label)
    roots = connected_components(ends.select(F.col("ra").alias("a"), F.col("comp").alias("b")))
    root = labelled(arrays.select("doc_id"), label).join(roots.withColumnRenamed("node", "comp"), "comp", "left").select(F.col("doc_id").alias("class_id"), F.coalesce("component", "comp").alias("component_id"))
    out = classes.join(firsts, ["n", "fa", "fb"]).join(root, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, threshold: float = 0.75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-copy component; rows without an
    id go if a row with one is near."""
    rows = required(docs, id_col, text_col).toDF("doc_id", "text")
    _, shift = _shift(F.col("doc_id").cast("long"), rows)
    rows = rows.select(_node("doc_id", "text", shift).alias("doc_id"), "text")
    groups = _components(rows, Fraction(threshold).limit_denominator(1000), k)
    lost = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_lost")).distinct()
    names = docs.columns
    at = {c: f"_c{names.index(c)}" for c in (id_col, text_col)}
    named = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return named.join(lost, _node(at[id_col], at[text_col], shift) == F.col("_lost"), "left_anti").toDF(*names)
