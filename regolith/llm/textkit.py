"""Vectorised word, hash and blob primitives shared by the Arrow-batch operators.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  UTF-8 continuation and
lead bytes are all above that range, so byte runs and character runs agree.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_SEGMENT = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; a bijection, so it adds no collisions."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h = h * U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, _SEGMENT + 4096)
        p = np.full(size, _BASE, dtype=U64)
        q = np.full(size, pow(_BASE, -1, 1 << 64), dtype=U64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(p), np.cumprod(q)
    return _POWERS["p"], _POWERS["q"]


class Words:
    """Word boundaries of consecutive texts: word ``w`` of all is ``data[starts[w]:ends[w]]``;
    document ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n:
            ns = ~_SPACE[data]
            edge = np.zeros(n + 1, dtype=bool)
            edge[offsets] = True
            left = np.empty(n, dtype=bool)
            left[0] = True
            np.logical_or(~ns[:-1], edge[1:n], out=left[1:])
            right = np.empty(n, dtype=bool)
            right[-1] = True
            np.logical_or(~ns[1:], edge[1:n], out=right[:-1])
            self.starts = np.flatnonzero(ns & left)
            self.ends = np.flatnonzero(ns & right) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool) -> np.ndarray:
        table = _LOWER if lower else _SAME
        out = np.empty(len(self.starts), dtype=U64)
        w, total = 0, len(self.starts)
        while w < total:
            base = self.starts[w]
            to = max(w + 1, int(np.searchsorted(self.ends, base + _SEGMENT, side="right")))
            s, e = self.starts[w:to] - base, self.ends[w:to] - base
            raw = table[self.data[base : self.ends[to - 1]]]
            if len(raw) > _SEGMENT + 4096:  # one enormous word
                out[w] = int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little")
                w = to
                continue
            p, q = _powers(len(raw) + 1)
            acc = np.zeros(len(raw) + 1, dtype=U64)
            np.cumsum((raw.astype(U64) + U64(1)) * p[: len(raw)], out=acc[1:])
            out[w:to] = mix((acc[e] - acc[s]) * q[s] + (e - s).astype(U64) * U64(0xA0761D6478BD642F))
            w = to
        return out

    def of(self, d: int) -> slice:
        return slice(int(self.first[d]), int(self.first[d + 1]))


_SEEDS = mix(np.arange(1, 65, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (callers mask document edges)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    acc = h[:m] * _SEEDS[0]
    for j in range(1, k):
        acc += h[j : j + m] * _SEEDS[j]
    return mix(acc)


def fold(h: np.ndarray) -> int:
    """Hash of a whole sequence shorter than a window; its length takes part."""
    total = (h * _SEEDS[: len(h)]).sum(dtype=U64, keepdims=True)
    return int(mix(total + np.array([len(h) * 0x8EBC6AF09C88C6E3 % (1 << 64)], dtype=U64))[0])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``target`` bytes, at least one document each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + target, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups ``key`` (small unsigned ints) stably, and each bucket's bounds."""
    order = np.argsort(key.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(key.astype(np.int64), minlength=buckets))))
    return order, bounds


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file bytes for a scan.  Where it has none (a plan over local
    rows or an RDD states the largest number), the strings are measured by one aggregate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 52:
        return size
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    return sum(x or 0 for x in df.agg(*texts).first()) if texts else 1 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(df: DataFrame, mb: int = 8) -> int:
    """Chunks of about ``mb`` MB of text: a function of the input's size alone."""
    return max(8, -(-2 * estimated_bytes(df) // (mb << 20)))


BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows, so that neither the JVM's
    off-heap buffers nor a Python worker hold tens of MB of texts or arrays a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(key, "10000"))
    if have <= 0 or have > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder that every executor can reach: below the session's checkpoint dir.

    Without that setting a local session gets a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = have.get() if have.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="regolith-shared-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def required(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by exact name, whatever else the table holds."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    # by position: other columns may differ from these in case alone
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def without_ids(df: DataFrame, id_col: str, lost: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not among ``lost`` (one column); null equals null."""
    at, names = df.columns.index(id_col), df.columns
    rows = df.toDF(*[f"_c{i}" for i in range(len(names))])
    lost = lost.toDF("_lost")
    return rows.join(lost, rows[f"_c{at}"].eqNullSafe(lost["_lost"]), "left_anti").toDF(*names)
