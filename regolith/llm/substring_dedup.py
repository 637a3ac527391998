"""Substring dedup over a compacted graph of repeated word k-mers.

Method
------
The corpus is read as a De Bruijn graph whose edges are windows of ``k`` consecutive words
and whose nodes are the ``k - 1`` words that neighbouring windows share.

1. Documents are dealt to chunks by id (one exchange of the texts, reused by every later
   step).  Each chunk sends the 32-bit fingerprints of its distinct edges to buckets, which
   answer with those that two chunks have.
2. For these edges alone the full 64-bit hash and the chunk's first coordinate travel; each
   bucket names the edge's owner, the occurrence in the smallest document.
3. Back in its chunk, an edge with an owner in a smaller document is repeated.  A run of
   repeated edges whose owners advance in step is a path without branches and compacts to
   one span ``(start, length, owner coordinate)``.
4. Spans join the chunk of their owner by source coordinate and fetch its words; they join
   their own chunk and only words that are equal one by one are removed.

A chunk sends an edge once however often it has it, and asks for an owner's span once with all
places it covers, so a frequent passage costs its bucket and its owner one row a chunk.

Defined results: null text counts as no words; a null id counts as larger than all others;
rows of one id do not see each other; texts under ``k`` words stay whole; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Words, bound_batches, by_bucket, chunk_count, flat, power_of_two, required, windows

_LAST = (1 << 63) - 1


class Chunk:
    """A chunk's documents in (id, text) order, with words and edge hashes."""

    def __init__(self, table: pa.Table, k: int, hashed: bool = True):
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.ids = table.column("doc_id").to_numpy().astype(np.int64)
        self.data, self.offsets = flat(table.column("text"))
        self.words = Words(self.data, self.offsets)
        first = self.words.first
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(first))
        if hashed:
            h = windows(self.words.hashes(lower=False), k)
            at = np.arange(len(h))
            self.g = at[self.doc[at] == self.doc[at + k - 1]] if len(h) else at
            self.h = h[self.g]

    def text(self, a: int, b: int) -> bytes:
        return b" ".join(self.data[self.words.starts[a] : self.words.ends[b - 1]].tobytes().split())


_FINGER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())])


def _fingers(k: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FINGER.empty_table()
        h = np.unique(Chunk(table, k).h)
        order, at = by_bucket((h & U64(buckets - 1)).astype(np.uint32), buckets)
        fp = (h[order] >> U64(32)).astype(np.uint32)
        rows = [i for i in range(buckets) if at[i + 1] > at[i]]
        return pa.Table.from_arrays(
            [pa.array(rows, pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([fp[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())],
            schema=_FINGER,
        )

    return run


def _common_fingers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _FINGER.empty_table()
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("body")]
    uniq, n = np.unique(np.concatenate(parts), return_counts=True)
    shared = uniq[n > 1]
    out = []
    for p in parts:
        at = np.searchsorted(shared, p)
        at[at == len(shared)] = 0
        out.append(np.unique(p[shared[at] == p]).tobytes() if len(shared) else b"")
    return pa.Table.from_arrays([table.column("bucket").combine_chunks(), table.column("chunk").combine_chunks(), pa.array(out, pa.binary())], schema=_FINGER)


_EDGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("g", pa.binary())])
_EDGE_SQL = "bucket int, chunk int, h binary, doc binary, g binary"


def _edges(k: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, common: pa.Table) -> pa.Table:
        if not table.num_rows or not common.num_rows:
            return _EDGE.empty_table()
        # fingerprint and bucket together are one sorted key
        have = [
            (np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(U64) << U64(32)) | U64(b)
            for b, x in zip(common.column("bucket").to_pylist(), common.column("body"), strict=True)
        ]
        have = np.sort(np.concatenate(have))
        if not len(have):
            return _EDGE.empty_table()
        c = Chunk(table, k)
        want = (c.h & U64(0xFFFFFFFF00000000)) | (c.h & U64(buckets - 1))
        order = np.argsort(want)
        at = np.empty(len(want), dtype=np.int64)
        at[order] = np.searchsorted(have, want[order])
        at[at == len(have)] = 0
        hit = np.flatnonzero(have[at] == want)
        h, first = np.unique(c.h[hit], return_index=True)
        first = np.sort(first)  # source order keeps ids and coordinates rising
        g = c.g[hit[first]]
        h, doc = c.h[hit[first]], c.ids[c.doc[g]]
        order, at = by_bucket((h & U64(buckets - 1)).astype(np.uint32), buckets)
        h, doc, g = h[order], doc[order], g[order].astype(np.uint32)
        rows = [i for i in range(buckets) if at[i + 1] > at[i]]
        cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())
        return pa.Table.from_arrays([pa.array(rows, pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), cut(h), cut(doc), cut(g)], schema=_EDGE)

    return run


_OWNER = pa.schema([("chunk", pa.int32()), ("g", pa.binary()), ("oc", pa.binary()), ("og", pa.binary())])


def _owners(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The smallest document's occurrence of each edge, for chunks that have it later."""
    if not table.num_rows:
        return _OWNER.empty_table()
    read = lambda c, t: [np.frombuffer(x.as_buffer(), dtype=t) for x in table.column(c)]
    hs = read("h", U64)
    h, doc, g = np.concatenate(hs), np.concatenate(read("doc", np.int64)), np.concatenate(read("g", np.uint32))
    chunks = np.array(table.column("chunk").to_pylist(), dtype=np.uint32)
    chunk = np.repeat(chunks, [len(x) for x in hs])
    order = np.lexsort((doc, h))
    sh = h[order]
    head = np.concatenate(([True], sh[1:] != sh[:-1]))
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    mine = order[~head]
    lead = lead[~head]
    order = np.argsort(chunk[mine], kind="stable")
    mine, lead = mine[order], lead[order]
    who, start = np.unique(chunk[mine], return_index=True)
    ends = [*start[1:], len(mine)]
    cut = lambda x: pa.array([x[s:e].astype(np.uint32).tobytes() for s, e in zip(start, ends, strict=True)], pa.binary())
    return pa.Table.from_arrays([pa.array(who.astype(np.int32)), cut(g[mine]), cut(chunk[lead]), cut(g[lead])], schema=_OWNER)


_SPAN = pa.schema([("oc", pa.int32()), ("og", pa.int64()), ("words", pa.int64()), ("chunk", pa.int32()), ("g", pa.binary())])
_SPAN_SQL = "oc int, og long, words long, chunk int, g binary"


def _paths(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, owners: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SPAN.empty_table()
        c = Chunk(table, k)
        if not len(c.h):
            return _SPAN.empty_table()
        _, first, inv = np.unique(c.h, return_index=True, return_inverse=True)
        me = key[0].as_py()
        oc = np.full(len(first), me, dtype=np.int64)
        og = c.g[first].astype(np.int64)
        away = np.zeros(len(first), dtype=bool)
        if owners.num_rows:
            read = lambda n: np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in owners.column(n)]).astype(np.int64)
            at = inv[np.searchsorted(c.g, read("g"))]
            oc[at], og[at], away[at] = read("oc"), read("og"), True
        doc = c.doc[c.g]
        repeated = away[inv] | (c.ids[doc] > c.ids[doc[first]][inv])
        at = np.flatnonzero(repeated)
        if not len(at):
            return _SPAN.empty_table()
        g, d, o, q = c.g[at].astype(np.int64), doc[at], oc[inv[at]], og[inv[at]]
        joins = (g[1:] == g[:-1] + 1) & (d[1:] == d[:-1]) & (o[1:] == o[:-1]) & (q[1:] == q[:-1] + 1)
        head = np.flatnonzero(np.concatenate(([True], ~joins)))
        length = np.diff(np.concatenate((head, [len(at)]))) + k - 1
        # spans of one owner span are one request with all their places, however many there are
        o, q, g = o[head], q[head], g[head]
        order = np.lexsort((g, length, q, o))
        o, q, g, length = o[order], q[order], g[order], length[order].astype(np.int64)
        lead = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (q[1:] != q[:-1]) | (length[1:] != length[:-1]))))
        places = [x.tobytes() for x in np.split(g, lead[1:])]
        return pa.Table.from_arrays([pa.array(o[lead].astype(np.int32)), pa.array(q[lead]), pa.array(length[lead]), pa.array(np.full(len(lead), me, dtype=np.int32)), pa.array(places, pa.binary())], schema=_SPAN)

    return run


_SLICE = pa.schema([("chunk", pa.int32()), ("g", pa.binary()), ("words", pa.int64()), ("body", pa.binary())])


def _slices(key: tuple[pa.Scalar, ...], table: pa.Table, spans: pa.Table) -> pa.Table:
    if not table.num_rows or not spans.num_rows:
        return _SLICE.empty_table()
    c = Chunk(table, 1, hashed=False)
    body = [c.text(a, a + n) for a, n in zip(spans.column("og").to_pylist(), spans.column("words").to_pylist(), strict=True)]
    return pa.Table.from_arrays([spans.column("chunk").combine_chunks(), spans.column("g").combine_chunks(), spans.column("words").combine_chunks(), pa.array(body, pa.binary())], schema=_SLICE)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_KEPT_SQL = "doc_id long, n_words long, n_removed long, kept string"


def _remove(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, slices: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEPT.empty_table()
        c = Chunk(table, k, hashed=False)
        gone = np.zeros(len(c.doc) + 1, dtype=np.int64)
        for places, n, body in zip(slices.column("g"), slices.column("words").to_pylist(), slices.column("body"), strict=True):
            body = body.as_py()
            for g in np.frombuffer(places.as_buffer(), dtype=np.int64):
                own = c.text(g, g + n)
                if own == body:
                    gone[g] += 1
                    gone[g + n] -= 1
                    continue
                # unequal somewhere: only whole windows of equal words count
                same = np.array([x == y for x, y in zip(own.split(b" "), body.split(b" "), strict=True)])
                for i in range(n - k + 1):
                    if same[i : i + k].all():
                        gone[g + i] += 1
                        gone[g + i + k] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        first, raw = c.words.first, c.data.tobytes()
        n_words = np.diff(first)
        n_gone = np.add.reduceat(np.concatenate((gone, [False])).astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, dtype=np.int64)
        n_gone[n_words == 0] = 0
        kept = []
        for d in range(len(c.ids)):
            words = raw[c.offsets[d] : c.offsets[d + 1]].split()
            if n_gone[d]:
                words = [words[i] for i in np.flatnonzero(~gone[first[d] : first[d + 1]])]
            kept.append(b" ".join(words))
        return pa.Table.from_arrays([pa.array(c.ids), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], schema=_KEPT)

    return run


def substring_dedup(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the words that a ``k``-word
    window repeats from a document with a smaller id; kept words are joined by one space."""
    bound_batches(docs.sparkSession)
    docs = required(docs, id_col, text_col).toDF("doc_id", "text")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = chunk_count(docs)
    buckets = power_of_two(max(32, chunks))
    docs = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    own = docs.groupBy("chunk")
    fingers = own.applyInArrow(_fingers(k, buckets), "bucket int, chunk int, body binary")
    common = fingers.groupBy("bucket").applyInArrow(_common_fingers, "bucket int, chunk int, body binary")
    edges = own.cogroup(common.groupBy("chunk")).applyInArrow(_edges(k, buckets), _EDGE_SQL)
    owners = edges.groupBy("bucket").applyInArrow(_owners, "chunk int, g binary, oc binary, og binary")
    spans = own.cogroup(owners.groupBy("chunk")).applyInArrow(_paths(k), _SPAN_SQL)
    slices = own.cogroup(spans.groupBy("oc")).applyInArrow(_slices, "chunk int, g binary, words long, body binary")
    kept = own.cogroup(slices.groupBy("chunk")).applyInArrow(_remove(k), _KEPT_SQL)
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))
