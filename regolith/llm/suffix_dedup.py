"""Removal of repeated byte strings by a column-wise Burrows-Wheeler transform of aligned segments.

Method
------
1. Documents are dealt to chunks by id (one exchange of the texts, reused by every later step).  The
   windows of ``length`` bytes are cut into runs that share an anchor: the place of the smallest hash of
   ``anchor`` bytes inside, the first of equal ones.  Equal windows have equal anchors at equal distances,
   wherever they stand.  Chunks send fingerprints of anchors to buckets, which name those that occur
   twice: other runs hold no repeated window.
2. Runs of anchors that occur over ``HOT`` times (a common phrase in many contexts) are asked for by the
   hash of each whole window in the same way, and go on as single windows.
3. What is left travels as segments, a run's windows with the bytes they reach, to the bucket of its
   anchor: a chunk sends equal segments once.  A bucket's segments form collections, aligned at their
   anchors, and each collection's transform is built column by column from the right: a round inserts
   the next symbol of every segment, which sorts the column's suffixes from the order of the last one,
   and updates the common prefixes of neighbours by range minima over the last ones.
4. Neighbours with a common prefix of ``length`` form a class; all but its smallest place are repeats.
   They return to their chunk as spans, where the bytes they cover are cut.

In the literature a suffix is inserted among those of all columns, and the transform lies in files that each
round reads and writes in order, as large as the corpus.  Here windows of different columns are never
equal, so a round keeps the order of its own column alone, and a collection has some ``COLLECTION``
segments, so that this order is an array; what is external are Spark's exchange files.

Defined results: null text counts as empty; a null id counts as larger than all others and comes back
null; rows of one id are ordered by text and see each other as one document would; texts under ``length`` bytes stay whole; texts of
one symbol and very long texts are runs like others, a text must fit a task some 60 times; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, bound_batches, by_bucket, chunk_count, flat, mix, power_of_two, required

LENGTH, ANCHOR = 100, 32
HOT = 4096
COLLECTION = 16_000
_BLOCK = 1 << 16
_PLACE = U64((1 << 17) - 1)
_STEP = 0x9E3779B97F4A7C15 | 1
_SYMBOL = mix(np.arange(1, 257, dtype=U64))


def rolled(data: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` bytes from each place on."""
    cur, step, acc, off = _SYMBOL[data], 1, None, 0
    power = _STEP  # to the ``step``
    while m:
        if m & 1:
            part = cur[off:]
            acc = part if acc is None else acc[: len(part)] * U64(power) + part[: len(acc)]
            off += step
        m >>= 1
        if m:
            cur = cur[:-step] * U64(power) + cur[step:]
            power = power * power % (1 << 64)
            step *= 2
    return mix(acc)


class Chunk:
    """A chunk's documents in (id, text) order as one run of bytes."""

    def __init__(self, table: pa.Table, length: int):
        order = pc.sort_indices(table, [("last", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.last = table.column("last").to_numpy(zero_copy_only=False).astype(bool)
        self.ids = table.column("doc_id").to_numpy().astype(np.int64)
        self.data, self.offsets = flat(table.column("text"))
        self.length = length
        self.doc = None

    def whole(self) -> np.ndarray:
        """Whether a window of the document starts at each place."""
        at = np.zeros(len(self.data) + 1, dtype=np.int32)
        a, b = self.offsets[:-1], np.maximum(self.offsets[:-1], self.offsets[1:] - self.length + 1)
        np.add.at(at, a, 1)
        np.add.at(at, b, -1)
        return np.cumsum(at[:-1]) > 0

    def runs(self, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, distance to the anchor, hash of the anchor) of runs."""
        ok = self.whole()
        n, w = len(self.data), self.length - anchor + 1
        starts, anchors, values = [], [], []
        for a in range(0, max(0, n - self.length + 1), _BLOCK):
            # hash above, place in the block below: minima are the first of the smallest
            h = rolled(self.data[a : min(n, a + _BLOCK + self.length - 1)], anchor)
            h = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
            size = 1
            while size * 2 <= w:
                h = np.minimum(h[:-size], h[size:])
                size *= 2
            if size < w:
                h = np.minimum(h[: len(h) - (w - size)], h[w - size :])
            mine = ok[a : a + len(h)]
            new = np.empty(len(h), dtype=bool)
            new[0] = True
            np.logical_or(h[1:] != h[:-1], ~mine[:-1], out=new[1:])
            at = np.flatnonzero(new & mine)
            starts.append(at + a)
            anchors.append((h[at] & _PLACE).astype(np.int64) - at)
            values.append(mix(h[at] & ~_PLACE))
        if not starts:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, U64)
        start = np.concatenate(starts)
        place = np.append(np.cumsum(ok), ok.sum())  # windows up to and with each place
        count = np.diff(np.append(place[start] - 1, ok.sum()))
        return start, count, np.concatenate(anchors), np.concatenate(values)

    def windows_of(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of every window of some runs."""
        place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out = np.empty(len(place), dtype=U64)
        bounds = np.searchsorted(place, np.arange(0, len(self.data) + _BLOCK, _BLOCK))
        for i in range(len(bounds) - 1):
            x, y = bounds[i], bounds[i + 1]
            if y > x:
                a = i * _BLOCK
                out[x:y] = rolled(self.data[a : a + _BLOCK + self.length - 1], self.length)[place[x:y] - a]
        return place, out

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1


_FINGER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()), ("n", pa.binary())])
_FINGER_SQL = "bucket int, chunk int, kind int, body binary, n binary"


def _sent(chunk: int, h: np.ndarray, buckets: int) -> pa.Table:
    """Fingerprints of hashes with the number of times each stands here, a row a bucket."""
    h, n = np.unique(h, return_counts=True)
    order, at = by_bucket((h & U64(buckets - 1)).astype(np.uint32), buckets)
    fp, n = (h[order] >> U64(32)).astype(np.uint32), np.minimum(n[order], 65535).astype(np.uint16)
    rows = [i for i in range(buckets) if at[i + 1] > at[i]]
    cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())
    return pa.Table.from_arrays([pa.array(rows, pa.int32()), pa.array([chunk] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int32()), cut(fp), cut(n)], schema=_FINGER)


def _survey(length: int, anchor: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _sent(key[0].as_py(), Chunk(table, length).runs(anchor)[3], buckets)

    return run


def _common(hot: int, kinds: tuple[int, int]):
    """Fingerprints that occur twice and at most ``hot`` times (first kind), or oftener (second)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("body")]
        n = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in table.column("n")]).astype(np.int64)
        u, inv = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inv, weights=n)
        level = np.where(total > hot, 2, np.where(total > 1, 1, 0))[inv]
        ends = np.cumsum([len(p) for p in parts])
        out = [[], [], [], []]
        for chunk, p, lv in zip(table.column("chunk").to_pylist(), parts, np.split(level, ends[:-1]), strict=True):
            for x in (1, 2):
                found = np.unique(p[lv == x])
                if len(found):
                    for col, v in zip(out, (key[0].as_py(), chunk, kinds[x - 1], found.tobytes()), strict=True):
                        col.append(v)
        return pa.Table.from_arrays([*(pa.array(c, pa.int32()) for c in out[:3]), pa.array(out[3], pa.binary()), pa.array([b""] * len(out[0]), pa.binary())], schema=_FINGER)

    return run


def _answers(common: pa.Table, kind: int) -> np.ndarray:
    """Sorted (fingerprint, bucket) keys of one kind."""
    rows = [(np.frombuffer(x.as_buffer(), dtype=np.uint32).astype(U64) << U64(32)) | U64(b) for b, k, x in zip(common.column("bucket").to_pylist(), common.column("kind").to_pylist(), common.column("body"), strict=True) if k == kind]
    return np.sort(np.concatenate(rows)) if rows else np.zeros(0, dtype=U64)


def _among(h: np.ndarray, have: np.ndarray, buckets: int) -> np.ndarray:
    if not len(have) or not len(h):
        return np.zeros(len(h), dtype=bool)
    want = (h & U64(0xFFFFFFFF00000000)) | (h & U64(buckets - 1))
    u, inv = np.unique(want, return_inverse=True)
    at = np.searchsorted(have, u)
    at[at == len(have)] = 0
    return (have[at] == u)[inv]


_TWICE, _HOT, _WINDOW = 1, 2, 3


def _survey_windows(length: int, anchor: int, buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, common: pa.Table) -> pa.Table:
        have = _answers(common, _HOT)
        if not table.num_rows or not len(have):
            return _FINGER.empty_table()
        c = Chunk(table, length)
        start, count, _, value = c.runs(anchor)
        hot = _among(value, have, buckets)
        return _sent(key[0].as_py(), c.windows_of(start[hot], count[hot])[1], buckets)

    return run


_SEGMENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("own", pa.bool_()), ("value", pa.binary()), ("last", pa.binary()), ("doc", pa.binary()), ("g", pa.binary()), ("n", pa.binary()), ("to", pa.binary()), ("body", pa.binary())])
_SEGMENT_SQL = "bucket int, chunk int, own boolean, value binary, last binary, doc binary, g binary, n binary, to binary, body binary"


def packed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def unpacked(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _segments(length: int, anchor: int, buckets: int):
    """Segments that may hold a repeated window; of equal ones the first, the others as spans."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, common: pa.Table) -> pa.Table:
        if not table.num_rows or not common.num_rows:
            return _SEGMENT.empty_table()
        c, me = Chunk(table, length), key[0].as_py()
        start, count, to, value = c.runs(anchor)
        hot = _among(value, _answers(common, _HOT), buckets)
        keep = _among(value, _answers(common, _TWICE), buckets) & ~hot
        place, h = c.windows_of(start[hot], count[hot])
        twice = _among(h, _answers(common, _WINDOW), buckets)
        start = np.concatenate((start[keep], place[twice]))
        count = np.concatenate((count[keep], np.ones(int(twice.sum()), dtype=np.int64)))
        to = np.concatenate((to[keep], np.zeros(int(twice.sum()), dtype=np.int64)))
        value = np.concatenate((value[keep], h[twice]))
        order = np.argsort(start, kind="stable")  # the first of equal ones is the smallest place
        start, count, to, value = start[order], count[order], to[order], value[order]
        raw, known, first, again = c.data.tobytes(), set(), [], []
        for i, (a, n) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
            x = raw[a : a + n + length - 1]
            if x in known:
                again.append(i)
            else:
                known.add(x)
                first.append(i)
        del known
        first, again = np.array(first, dtype=np.int64), np.array(again, dtype=np.int64)
        order, at = by_bucket((value[first] & U64(buckets - 1)).astype(np.uint32), buckets)
        first = first[order]
        d = c.document(start[first])
        rows = [i for i in range(buckets) if at[i + 1] > at[i]]
        cut = lambda x, kind: [x[at[i] : at[i + 1]].astype(kind).tobytes() for i in rows]
        spans = list(zip(start[first].tolist(), (start[first] + count[first] + length - 1).tolist(), strict=True))
        cols = [cut(value[first], U64), cut(c.last[d], np.uint8), cut(c.ids[d], np.int64), cut(start[first], np.int64), cut(count[first], np.uint8), cut(to[first], np.uint8), [packed(b"".join([raw[x:y] for x, y in spans[at[i] : at[i + 1]]])) for i in rows]]
        if len(again):
            rows.append(me % buckets)
            for col, x in zip(cols, (b"", b"", b"", start[again].tobytes(), count[again].astype(np.uint8).tobytes(), b"", b""), strict=True):
                col.append(x)
        own = [False] * (len(rows) - bool(len(again))) + [True] * bool(len(again))
        return pa.Table.from_arrays([pa.array(rows, pa.int32()), pa.array([me] * len(rows), pa.int32()), pa.array(own, pa.bool_()), *(pa.array(x, pa.binary()) for x in cols)], schema=_SEGMENT)

    return run


def _range_min(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of ``lcp[lo..hi]`` for each pair, by minima over powers of two."""
    level = _LOG[hi - lo + 1]
    top = int(level.max())
    table = np.empty((top + 1, len(lcp)), dtype=np.uint8)
    table[0] = lcp
    for i in range(top):
        size = 1 << i
        np.minimum(table[i, :-size], table[i, size:], out=table[i + 1, : len(lcp) - size])
        table[i + 1, len(lcp) - size :] = 0
    flat, base = table.reshape(-1), level.astype(np.int64) * len(lcp)
    return np.minimum(flat[base + lo], flat[base + hi + 1 - (1 << level.astype(np.int64))])


def _logs(n: int) -> np.ndarray:
    """Floor of the binary logarithm of 0 (as 1) to n."""
    out = np.frexp(np.arange(n + 1).astype(np.float64))[1] - 1
    out[0] = 0
    return out.astype(np.uint8)


_LOG = _logs(1 << 12)


class Column:
    """One column of a collection's transform: its suffixes' segments in order, and the common
    prefixes of each with the one before (at most ``most``)."""

    def __init__(self, most: int):
        self.most = most
        self.who, self.lcp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)

    def insert(self, symbols: np.ndarray, entering: np.ndarray) -> None:
        """Put one more symbol (1 to 255; 0: none left) before every suffix; ``entering`` segments begin with it."""
        who = np.concatenate((entering, self.who))  # an end sorts before every symbol
        lcp = np.concatenate((np.zeros(len(entering), dtype=np.uint8), self.lcp))
        bwt = symbols[who]
        order = np.argsort(bwt, kind="stable")
        order = order[len(order) - np.count_nonzero(bwt) :]
        self.who, self.lcp = who[order], np.zeros(len(order), dtype=np.uint8)
        sorted_ = bwt[order]
        same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
        if len(same):
            common = _range_min(lcp, order[same - 1] + 1, order[same])
            self.lcp[same] = np.minimum(common, self.most - 1) + np.uint8(1)

    def groups(self) -> np.ndarray:
        """First places of classes of suffixes with a common prefix of ``most``."""
        return np.flatnonzero(self.lcp < self.most)


def repeats(data: np.ndarray, ends: np.ndarray, windows: np.ndarray, to: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that equals one of a segment with a smaller rank.

    Segment ``i`` is the bytes up to ``ends[i]``: ``windows[i]`` windows of ``length``, the first of which is ``to[i]``
    bytes before the segment's anchor.  ``rank`` orders the segments' anchors by place."""
    global _LOG
    if len(ends) >= len(_LOG):
        _LOG = _logs(2 * len(ends))
    size = windows + length - 1
    right = to - windows + 1  # the last window's distance to the anchor is the column of the last byte
    columns = np.zeros((int((right + size).max()), len(ends)), dtype=np.uint8)
    of = np.repeat(np.arange(len(ends)), size)
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # from the left
    columns[(right + size - 1)[of] - nth, of] = data[np.repeat(ends - size, size) + nth] + np.uint8(1)  # UTF-8 has no byte 255
    by = np.argsort(right, kind="stable")
    bounds = np.searchsorted(right[by], np.arange(len(columns) + 1))
    column, out = Column(length), ([], [])
    for j, symbols in enumerate(columns):
        column.insert(symbols, by[bounds[j] : bounds[j + 1]])
        first = column.groups()
        if len(first) < len(column.who):
            mine = rank[column.who]
            least = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(mine))))
            seg = column.who[mine != least]
            out[0].append(seg)
            out[1].append((right + size - 1)[seg] - j)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate((none, *out[0])), np.concatenate((none, *out[1]))


_SPANS = pa.schema([("chunk", pa.int32()), ("g", pa.binary()), ("n", pa.binary())])


def _repeats(length: int, collection: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.array(table.column("own").to_pylist(), dtype=bool)
        out = [table.filter(pa.array(own)).select(["chunk", "g", "n"]).cast(_SPANS)]
        rows = table.filter(pa.array(~own))
        if not rows.num_rows:
            return out[0]
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), dtype=t) for x in rows.column(c)])
        n, to, g = read("n", np.uint8).astype(np.int64), read("to", np.uint8).astype(np.int64), read("g", np.int64)
        chunk = np.repeat(np.array(rows.column("chunk").to_pylist()), [len(x.as_buffer()) for x in rows.column("n")])
        data = np.frombuffer(b"".join([unpacked(x.as_py()) for x in rows.column("body")]), dtype=np.uint8)
        ends = np.cumsum(n + length - 1)
        # anchors by place; places of one id are of one chunk
        rank = np.empty(len(n), dtype=np.int64)
        rank[np.lexsort((g + to, read("doc", np.int64), read("last", np.uint8)))] = np.arange(len(n))
        # collections hold whole groups of one value
        value = read("value", U64)
        by = np.argsort(value, kind="stable")
        edges = np.append(np.flatnonzero(value[by][1:] != value[by][:-1]) + 1, len(by))
        who, start, windows, a = [], [], [], 0
        while a < len(by):
            b = int(edges[np.searchsorted(edges, min(a + collection, len(by)))])
            mine = by[a:b]
            seg, off = repeats(data, ends[mine], n[mine], to[mine], rank[mine], length)
            order = np.lexsort((off, seg))
            seg, off = seg[order], off[order]
            head = np.flatnonzero((np.diff(seg, prepend=-1) != 0) | (np.diff(off, prepend=-2) != 1))
            lead = mine[seg[head]]
            who.append(chunk[lead])
            start.append(g[lead] + off[head])
            windows.append(np.diff(np.append(head, len(seg))))
            a = b
        who, start, windows = np.concatenate(who), np.concatenate(start), np.concatenate(windows)
        if not len(who):
            return out[0]
        order = np.argsort(who, kind="stable")
        who, start, windows = who[order], start[order], windows[order]
        chunks, first = np.unique(who, return_index=True)
        ends = np.append(first[1:], len(who))
        cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
        out.append(pa.Table.from_arrays([pa.array(chunks.astype(np.int32)), cut(start, np.int64), cut(windows, np.uint8)], schema=_SPANS))
        return pa.concat_tables(out)

    return run


_KEPT = pa.schema([("last", pa.bool_()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_KEPT_SQL = "last boolean, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, spans: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEPT.empty_table()
        c = Chunk(table, length)
        at = np.zeros(len(c.data) + 1, dtype=np.int32)
        for g, n in zip(spans.column("g"), spans.column("n"), strict=True):
            g = np.frombuffer(g.as_buffer(), dtype=np.int64)
            np.add.at(at, g, 1)
            np.add.at(at, g + np.frombuffer(n.as_buffer(), dtype=np.uint8) + (length - 1), -1)
        gone = np.append(np.cumsum(at[:-1]) > 0, False)
        head = gone[:-1] & np.concatenate(([True], ~gone[:-2]))[: len(gone) - 1]
        head[c.offsets[:-1][c.offsets[:-1] < len(head)]] |= gone[:-1][c.offsets[:-1][c.offsets[:-1] < len(head)]]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[c.offsets])
        n_gone, n_spans = total(gone[:-1]), total(head)
        left = c.data[~gone[:-1]].tobytes()
        size = np.diff(c.offsets)
        ends = np.cumsum(size - n_gone).tolist()
        kept = [left[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.Table.from_arrays([pa.array(c.last), pa.array(c.ids), pa.array(size), pa.array(n_gone.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(kept, pa.binary())], schema=_KEPT)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, collection: int = COLLECTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each row's UTF-8 bytes without those covered by a
    ``length``-byte string that also starts earlier: in a smaller id, or before in the same document."""
    if not 1 <= anchor <= length <= 250:
        raise ValueError("anchor is 1 to length bytes, length at most 250")
    bound_batches(docs.sparkSession)
    docs = required(docs, id_col, text_col).toDF("doc_id", "text")
    docs = docs.select(F.col("doc_id").isNull().alias("last"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = chunk_count(docs)
    buckets = power_of_two(max(32, chunks))
    docs = docs.select(F.pmod(F.xxhash64("last", "doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "last", "doc_id", "text")
    own = docs.groupBy("chunk")
    runs = own.applyInArrow(_survey(length, anchor, buckets), _FINGER_SQL)
    common = runs.groupBy("bucket").applyInArrow(_common(hot, (_TWICE, _HOT)), _FINGER_SQL)
    hot_windows = own.cogroup(common.groupBy("chunk")).applyInArrow(_survey_windows(length, anchor, buckets), _FINGER_SQL)
    both = common.unionByName(hot_windows.groupBy("bucket").applyInArrow(_common(1 << 62, (_WINDOW, _WINDOW)), _FINGER_SQL))
    segments = own.cogroup(both.groupBy("chunk")).applyInArrow(_segments(length, anchor, buckets), _SEGMENT_SQL)
    spans = segments.groupBy("bucket").applyInArrow(_repeats(length, collection), "chunk int, g binary, n binary")
    kept = own.cogroup(spans.groupBy("chunk")).applyInArrow(_remove(length), _KEPT_SQL)
    return kept.select(F.when(~F.col("last"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
