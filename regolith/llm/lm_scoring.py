"""Language-model scoring: a byte trie's code length beside a word-frequency baseline.

The trie (see :mod:`ppm`) is trained on all training texts and keeps all their strings.  The baseline needs every
word's count over the training texts: chunks send their distinct words once, with their
training count, to hash buckets; the buckets answer with totals in the order received, so
an answer is one number a word.  Frequent words therefore cost a bucket one row a chunk.

Defined results: null text is an empty text (its end alone); a null id trains, as no
remainder excludes it, and is not held out; with no training rows every word is unknown and
the trie is uniform over bytes; rows are scored one by one whether ids repeat or not; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ppm import PIECE, Asked, Model, answers, collected, low_orders, tally
from .textkit import U64, Words, bound_batches, by_bucket, chunk_count, flat, materialize, pieces, power_of_two, required

#: Strings up to which the trie is sent to workers; beyond, chunks ask for costs.
MAX_NODES = 1 << 20
END = U64(0x5EED0F7E97D0C5E1)
_BUILT: dict[str, Model] = {}

_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])
_BACK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("c", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(table: pa.Table, buckets: int):
    """The chunk's token hashes with documents, and its distinct ones in (bucket, hash) order."""
    data, off = flat(table.column("text"))
    words = Words(data, off)
    n = len(off) - 1
    doc = np.concatenate((np.repeat(np.arange(n), np.diff(words.first)), np.arange(n)))
    h = np.concatenate((words.hashes(lower=True), np.full(n, END)))
    uniq, inv = np.unique(h, return_inverse=True)
    order, at = by_bucket((uniq & U64(buckets - 1)).astype(np.uint32), buckets)
    place = np.empty(len(uniq), dtype=np.int64)
    place[order] = np.arange(len(uniq))
    return data, off, doc, uniq[order], place[inv], at


def _send(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SENT.empty_table()
        _, _, doc, uniq, inv, at = _tokens(table, buckets)
        trains = ~np.array(table.column("held_out").to_pylist(), dtype=bool)
        n = np.bincount(inv[trains[doc]], minlength=len(uniq)).astype(np.uint32)
        rows = np.flatnonzero(np.diff(at))  # no bucket is sent nothing
        cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())
        return pa.Table.from_arrays([pa.array(rows.astype(np.int32)), pa.array([key[0].as_py()] * len(rows), pa.int32()), cut(uniq), cut(n)], schema=_SENT)

    return run


def _total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A bucket: the training counts of each chunk's words in the order received, and in a row of
    its own (chunk -1) all training tokens and distinct words of the bucket."""
    if not table.num_rows:
        return _BACK.empty_table()
    hs = [np.frombuffer(x.as_buffer(), dtype=U64) for x in table.column("h")]
    uniq, inv = np.unique(np.concatenate(hs), return_inverse=True)
    total = np.bincount(inv, np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("n")]), len(uniq))
    back, at, out = total[inv], 0, []
    for h in hs:
        out.append(back[at : at + len(h)].astype(np.int64 if total.max(initial=0) >= 1 << 32 else np.uint32).tobytes())
        at += len(h)
    n = table.num_rows
    own = pa.Table.from_arrays([table.column("bucket").combine_chunks(), table.column("chunk").combine_chunks(), pa.array(out, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_BACK)
    sums = pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], schema=_BACK)
    return pa.concat_tables([own, sums])


def _score(buckets: int, total: int, distinct: int, token: str, sent):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = sent and Model(*sent.value)
        model = _BUILT[token]
        data, off, doc, uniq, inv, at = _tokens(table, buckets)
        c = np.zeros(len(uniq))
        costs = []
        for b, x in zip(back.column("bucket").to_pylist(), back.column("c"), strict=True):
            if b >= buckets:
                costs.append((b - buckets, x.as_buffer()))
                continue
            m = int(at[b + 1] - at[b])
            if m:
                raw = x.as_buffer()
                c[at[b] : at[b + 1]] = np.frombuffer(raw, dtype=np.int64 if raw.size == 8 * m else np.uint32)
        docs = len(off) - 1
        n = np.bincount(doc, minlength=docs)
        known = np.bincount(doc[c[inv] > 0], minlength=docs)
        base = np.bincount(doc, np.log10(c + 0.1)[inv], docs) - n * np.log10(total + 0.1 * (distinct + 1))
        if model is None:
            score = Asked(data, off, buckets).scores(costs, 1)[0]
        else:
            score = np.concatenate([model.score(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, PIECE)])
        return pa.Table.from_arrays(
            [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(n), pa.array(known), pa.array(np.full(docs, total, dtype=np.int64)), pa.array(base), pa.array(score)], schema=_SCORED
        )

    return run


def lm_scoring(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    bound_batches(docs.sparkSession)
    docs = required(docs, id_col, text_col)
    flag = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), flag.alias("held_out"))
    counts, models = collected(tally(rows.where("not held_out").select(F.lit("").alias("label"), "text")), max_nodes)
    empty = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
    sent = None if models is None else docs.sparkSession.sparkContext.broadcast(models.get("", empty))
    chunks = chunk_count(rows)
    buckets = power_of_two(max(16, chunks // 2))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text", "held_out")
    own = rows.groupBy("chunk")
    words = own.applyInArrow(_send(buckets), "bucket int, chunk int, h binary, n binary")
    # stored, so that the sums over all buckets are known before any text is scored
    back = materialize(words.groupBy("bucket").applyInArrow(_total, "bucket int, chunk int, c binary, total long, distinct long"), "words")
    sums = back.where("chunk = -1").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
    back = back.where("chunk >= 0").select("bucket", "chunk", "c")
    if sent is None:
        costs = answers(rows.select("chunk", "text"), counts, low_orders(counts), buckets, uuid.uuid4().hex)
        back = back.unionByName(costs.select((F.col("bucket") + buckets).alias("bucket"), "chunk", "c"))
    return own.cogroup(back.groupBy("chunk")).applyInArrow(_score(buckets, int(sums["total"] or 0), int(sums["distinct"] or 0), uuid.uuid4().hex, sent), _SCORED_SQL)
