"""Best-fit packing of token sequences by hierarchical residual merging.

Method
------
1. Each task tokenizes its texts and best-fits its pieces (longest first, into the open
   sequence with the least room that still takes them).
2. Sequences with at most ``slack`` tokens of room are closed.  The others travel on as
   items, are dealt to fewer groups of about ``fan_in`` items, and best-fit again as whole
   items; rounds repeat until one group has seen all that is open or a round gains
   almost nothing.
3. A sequence's place is the sum of the places of the items that hold it.

Only texts longer than a sequence are cut: into full pieces from the end, so that the first
piece takes the remainder.  Every piece is placed; none is dropped or shortened.

Ids come from the byte-level vocabulary.  Texts of ordinary characters are encoded by the
rank form of the same vocabulary, which is several times faster; texts with control
characters, characters from U+0400 on or a special token's string go to the file's own
tokenizer, so that neither Unicode tables nor special strings can differ.

Defined results: null is an empty text (its closing id alone); rows with equal or null ids
are packed as separate documents; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .textkit import bound_batches, materialize, required

LENGTH = 2048
SLACK = 8
FAN_IN = 20_000
_ODD = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9fЀ-\U0010ffff]")
_READY: dict[tuple[str, str], tuple] = {}


def _load(vocabulary: str, ranks: str):
    key = (vocabulary, ranks)
    if key not in _READY:
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(vocabulary)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        import public_tokenizers

        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        special = [t["content"] for t in json.load(open(vocabulary))["added_tokens"]]
        _READY[key] = (own, fast, special)
    return _READY[key]


def encoder(vocabulary: str, ranks: str):
    """text -> ids as unsigned 32-bit numbers, equal to the vocabulary file's own tokenizer."""
    own, fast, special = _load(vocabulary, ranks)

    def encode(text: str) -> np.ndarray:
        if _ODD.search(text) or any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


class BestFit:
    """Open sequences by room left; an item goes where the least room would remain."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # distinct rooms of open sequences, rising
        self.open: dict[int, list[int]] = {}
        self.used: list[int] = []

    def add(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of an item."""
        i = bisect.bisect_left(self.rooms, size)
        if i < len(self.rooms):
            room = self.rooms[i]
            seq = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                del self.rooms[i]
        else:
            room, seq = self.capacity, len(self.used)
            self.used.append(0)
        at = self.used[seq]
        self.used[seq] = at + size
        if room > size:
            left = room - size
            if left not in self.open:
                bisect.insort(self.rooms, left)
                self.open[left] = []
            self.open[left].append(seq)
        return seq, at


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each item, longest first, and the tokens each sequence holds."""
    seq, off = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    fit = BestFit(capacity)
    for i in np.argsort(-sizes, kind="stable"):
        seq[i], off[i] = fit.add(int(sizes[i]))
    return seq, off, np.array(fit.used, dtype=np.int64)


_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, at long, used long"


def _pack(length: int, vocabulary: str, ranks: str, end: int, with_ids: bool, group: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        # bins of different tasks never share a number
        base, made = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []

        def flush():
            nonlocal made
            size = np.array([h[3] for h in held], dtype=np.int64)
            seq, off, used = best_fit(size, length)
            cols = list(zip(*held, strict=True))
            yield pa.record_batch(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary()), pa.array(base + made + seq), pa.array(off), pa.array(used[seq])],
                names=[f.split()[0] for f in _PIECE_SQL.split(", ")],
            )
            made += len(used)
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                n = len(ids)
                a = 0
                for p in range(-(-n // length)):
                    b = n - ((n - 1 - a) // length) * length if p == 0 else a + length
                    raw = ids[a:b].tobytes()
                    held.append((doc, p, a, b - a, zlib.crc32(raw), raw if with_ids else None))
                    a = b
                if len(held) >= group:
                    yield from flush()
        if held:
            yield from flush()

    return run


_MERGE = pa.schema([("bin", pa.int64()), ("parent", pa.int64()), ("shift", pa.int64()), ("used", pa.int64())])
_MERGE_SQL = "bin long, parent long, shift long, used long"


def _merge(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _MERGE.empty_table()
        table = table.sort_by("bin")
        bins, used = table.column("bin").to_numpy(), table.column("used").to_numpy()
        seq, off, total = best_fit(used, length)
        # a merged sequence keeps the number of the item at its start
        name = np.empty(len(total), dtype=np.int64)
        first = off == 0
        name[seq[first]] = bins[first]
        return pa.Table.from_arrays([pa.array(bins), pa.array(name[seq]), pa.array(off), pa.array(total[seq])], schema=_MERGE)

    return run


def packing(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    length: int = LENGTH,
    end: int = 0,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) a piece, and its ``ids``
    as little-endian 32-bit numbers if asked for."""
    bound_batches(docs.sparkSession)
    for path in (vocabulary, ranks):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    docs = required(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    pieces = materialize(docs.mapInArrow(_pack(length, vocabulary, ranks, end, with_ids), _PIECE_SQL), "pieces")
    live = pieces.where(f"at = 0 and used < {length - slack}").select("bin", "used")
    n, where = live.count(), None
    for rounds in range(12):
        if not n:
            break
        groups = max(1, -(-n // fan_in))
        # neighbouring groups change from round to round, so that other items meet
        dealt = live.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(rounds)), F.lit(groups)).cast("int"))
        step = materialize(dealt.groupBy("group").applyInArrow(_merge(length), _MERGE_SQL), "merge")
        if where is None:
            where = step.select("bin", "parent", "shift")
        else:
            nxt = step.select(F.col("bin").alias("parent"), F.col("parent").alias("up"), F.col("shift").alias("more"))
            where = where.join(nxt, "parent", "left")
            where = where.select("bin", F.coalesce("up", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        live = step.where(f"bin = parent and used < {length - slack}").select("bin", "used")
        before, n = n, live.count()
        if groups == 1 or n > 0.98 * before:
            break
    out = pieces
    if where is not None:
        out = out.join(where, "bin", "left").withColumn("bin", F.coalesce("parent", "bin")).withColumn("at", F.col("at") + F.coalesce("shift", F.lit(0)))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return out.select(*kept, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
