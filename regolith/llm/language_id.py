"""Language identification by exact code length under one byte trie per language.

Each language's trie (see :mod:`ppm`) counts all its training texts and is then frozen.  A
text's language is the one whose trie gives it the shortest code, earlier names first on
ties; its score is that language's share of the total probability.

Defined results: null text or text without a letter is ``und`` with score 0; rows without
a language do not train; without any training rows all texts are ``und``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ppm import PIECE, Asked, Model, answers, collected, low_orders, tally
from .textkit import bound_batches, chunk_count, flat, pieces, power_of_two, required

#: Strings of all languages together up to which the tries are sent to workers; beyond, chunks ask for costs.
MAX_NODES = 1 << 20
_BUILT: dict[str, dict[str, Model]] = {}


def _rows(ids: pa.Array, texts: pa.Array, names: np.ndarray, lp: np.ndarray) -> pa.RecordBatch:
    """The language of each text from the scores by language and text."""
    part = pc.match_substring_regex(pc.fill_null(texts, ""), r"\pL").to_numpy(zero_copy_only=False)
    lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if len(names):
        best = lp.argmax(axis=0)
        share = 1 / np.power(10.0, np.maximum(lp - lp.max(axis=0), -300)).sum(axis=0)
        lang[part], score[part] = names[best[part]], share[part]
    return pa.record_batch([ids, pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def _predict(token: str, sent):
    def run(batches):
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = {k: Model(*v) for k, v in sent.value.items()}
        models = _BUILT[token]
        names = np.array(list(models), dtype=object)
        for batch in batches:
            texts = batch.column(1)
            data, off = flat(texts)
            for a, b in pieces(off, PIECE):
                lp = np.stack([m.score(data[off[a] : off[b]], off[a : b + 1] - off[a]) for m in models.values()]) if len(names) else np.zeros((0, b - a))
                yield _rows(batch.column(0).slice(a, b - a), texts.slice(a, b - a), names, lp)

    return run


def _predict_asked(buckets: int, names: list[str]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        batches = []
        if table.num_rows:
            ids, texts = (table.column(c).combine_chunks() for c in ("doc_id", "text"))
            ids, texts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, texts))
            costs = [(b, x.as_buffer()) for b, x in zip(back.column("bucket").to_pylist(), back.column("c"), strict=True)]
            lp = Asked(*flat(texts), buckets).scores(costs, len(names))
            batches.append(_rows(ids, texts, np.array(names, dtype=object), lp))
        return pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]))

    return run


def language_id(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``trains`` picks the rows to learn from."""
    bound_batches(docs.sparkSession)
    docs = required(docs, id_col, text_col, lang_col)
    known = docs.where(trains & F.col(f"`{lang_col}`").isNotNull())
    known = required(known, lang_col, text_col).toDF("label", "text").where("text is not null").select(F.col("label").cast("string"), "text")
    counts, models = collected(tally(known), max_nodes)
    rows = required(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    out = "doc_id long, lang_pred string, score double"
    if models is not None:
        return rows.mapInArrow(_predict(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(models)), out)
    low = low_orders(counts)
    chunks = chunk_count(rows)
    buckets = power_of_two(max(16, chunks // 2))
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text")
    back = answers(rows.select("chunk", "text"), counts, low, buckets, uuid.uuid4().hex)
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_predict_asked(buckets, list(low)), out)
