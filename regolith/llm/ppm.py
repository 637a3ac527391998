"""Prediction by partial matching over bytes, order 3, with frozen counts.

The trie holds the counts of every four-byte string of the training texts; a node's
children are the bytes seen after its context.  A symbol seen in the longest context
costs ``c / (n + q)`` there (``n`` occurrences, ``q`` distinct symbols: escape method C).
Otherwise the escape ``q / (n + q)`` is paid and the next shorter context is asked, without
the symbols that longer contexts have already excluded; below order 0 all bytes not yet
excluded are equally likely.  ``0xFF`` never occurs in UTF-8: it pads the start and ends a text.

No string is left out.  Up to a number of strings the counts are sent to every worker
(:class:`Model`).  Beyond it chunks of text ask for the costs of their distinct strings
(:func:`ask`, :class:`Asked`): a bucket holds all strings with the same two middle bytes, so it
has the counts of orders 3 and 2 of these, and the pairs of bytes that orders 1 and 0 need, at
most 2^16 a label, are sent (:func:`answers`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import by_bucket, flat, materialize, pieces

PAD = 0xFF
PIECE = 2 << 20
SIDE = 3072
#: Tries that a worker holds a table for (up to 38 MB each); with more labels costs are asked from buckets.
MAX_TABLES = 16
_LOW: dict[str, dict[str, list]] = {}


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with three pads before each and one (the next one's first) after; where each starts."""
    n = len(offsets) - 1
    out = np.full(len(data) + 3 * (n + 1), PAD, dtype=np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(3 * np.arange(1, n + 1), np.diff(offsets))] = data
    return out, offsets[:-1] + 3 * np.arange(1, n + 1)


def codes(buf: np.ndarray) -> np.ndarray:
    """The four-byte string that ends at position ``i + 3``, as a 32-bit number."""
    x = buf.astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[np.ndarray]] = {}

    def add(label, code, n):
        if label in held:
            a, b = held[label]
            code, inv = np.unique(np.concatenate((a, code)), return_inverse=True)
            n = np.bincount(inv, np.concatenate((b, n)), len(code)).astype(np.int64)
        held[label] = [code, n]

    def flush():
        for label, (code, n) in held.items():
            yield pa.record_batch([pa.array([label] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "code", "n"])
        held.clear()

    for batch in batches:
        labels = batch.column(0).to_pylist()
        by = {}
        for i, x in enumerate(labels):
            by.setdefault(x, []).append(i)
        for label, rows in by.items():
            data, off = flat(batch.column(1).take(pa.array(rows)))
            for a, b in pieces(off, PIECE):
                buf, start = padded(data[off[a] : off[b]], off[a : b + 1] - off[a])
                c = codes(buf)
                real = np.ones(len(c), dtype=bool)  # the second and third pad before a text are no symbols
                for back in (1, 2):
                    at = start - 3 - back
                    real[at[at >= 0]] = False
                at = len(buf) - 3 - np.arange(1, 3)
                real[at[at >= 0]] = False
                add(label, *np.unique(c[real], return_counts=True))
        if sum(len(x[0]) for x in held.values()) > 1 << 21:
            yield from flush()
    yield from flush()


def tally(docs: DataFrame) -> DataFrame:
    """(label, code, n): counts of four-byte strings over all rows of ``docs`` (label, text)."""
    parts = docs.select("label", "text").mapInArrow(_tally, "label string, code long, n long")
    return parts.groupBy("label", "code").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame, limit: int) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]] | None]:
    """The counts as a stored table, and on the driver by label (12 bytes a string) unless there
    are more than ``limit`` strings in all or more than ``MAX_TABLES`` labels."""
    counts = materialize(counts, "strings")
    if counts.count() > limit or counts.select("label").distinct().count() > MAX_TABLES:
        return counts, None
    rows = counts.toArrow()
    names, inv = np.unique(np.array(rows.column("label").to_pylist(), dtype=object), return_inverse=True)
    order, at = by_bucket(inv, len(names))
    code, n = rows.column("code").to_numpy().astype(np.uint32)[order], rows.column("n").to_numpy()[order]
    return counts, {x: (code[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for i, x in enumerate(names)}


def low_orders(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each label's counts of two-byte strings."""
    pairs = counts.groupBy("label", F.expr("code & 65535").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, tuple[list, list]] = {}
    for x, code, n in zip(*(pairs.column(c).to_pylist() for c in ("label", "code", "n")), strict=True):
        held = out.setdefault(x, ([], []))
        held[0].append(code)
        held[1].append(n)
    return {x: (np.array(out[x][0], dtype=np.uint32), np.array(out[x][1], dtype=np.int64)) for x in sorted(out)}


def _kids(code: np.ndarray, n: np.ndarray, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Symbols and counts by context of ``k`` bytes."""
    short, inv = np.unique(code & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
    total = np.bincount(inv, n, len(short)) if len(short) else np.zeros(0)
    ctx = short >> np.uint32(8)
    heads = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, dtype=np.int64)
    ends = np.append(heads[1:], len(ctx))[: len(heads)]
    syms = (short & np.uint32(0xFF)).astype(np.int64)
    return {int(ctx[s]): (syms[s:e], total[s:e]) for s, e in zip(heads, ends, strict=True)}


def _sums(cost: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over each text and its end."""
    stop = start + np.diff(offsets) + 1
    at = np.stack((start, stop), axis=1).ravel() - 3
    return np.add.reduceat(np.append(cost, np.float32(0)), at, dtype=np.float64)[::2]


class Asked:
    """A chunk's distinct strings by bucket, and its texts' scores from the buckets' answers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int):
        self.parts = [(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, PIECE)]
        found = [np.unique(codes(padded(*x)[0][:-2])) for x in self.parts]
        self.uniq = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)
        self.order, self.at = by_bucket((self.uniq >> np.uint32(8) & np.uint32(0xFFFF)) % np.uint32(buckets), buckets)

    def blobs(self) -> list[bytes]:
        by = self.uniq[self.order]
        return [by[a:b].tobytes() for a, b in zip(self.at, self.at[1:], strict=False)]

    def scores(self, answered, labels: int) -> np.ndarray:
        """log10 probability by label and text; ``answered`` gives (bucket, costs)."""
        cost = np.zeros((labels, len(self.uniq)), dtype=np.float32)
        for b, raw in answered:
            at = self.order[self.at[b] : self.at[b + 1]]
            if len(at):
                cost[:, at] = np.frombuffer(raw, dtype=np.float32).reshape(labels, len(at))
        out = []
        for data, offsets in self.parts:
            buf, start = padded(data, offsets)
            uniq, inv = np.unique(codes(buf[:-2]), return_inverse=True)
            at = np.searchsorted(self.uniq, uniq)
            out.append(np.stack([_sums(cost[i, at][inv], start, offsets) for i in range(labels)]))
        return np.concatenate(out, axis=1) if out else np.zeros((labels, 0))


def _ask(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = Asked(*flat(table.column("text")), buckets).blobs() if table.num_rows else []
        rows = [i for i, b in enumerate(blobs) if b]  # no bucket is asked nothing
        return pa.table({"bucket": pa.array(rows, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "codes": pa.array([blobs[i] for i in rows], pa.binary())})

    return run


def _answer(token: str, sent):
    def run(key: tuple[pa.Scalar, ...], have: pa.Table, want: pa.Table) -> pa.Table:
        if token not in _LOW:
            _LOW.clear()
            _LOW[token] = {x: [_kids(*low, 0), _kids(*low, 1)] for x, low in sent.value.items()}
        asked = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in want.column("codes")]
        uniq, inv = np.unique(np.concatenate(asked), return_inverse=True) if asked else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        label = np.array(have.column("label").to_pylist(), dtype=object)
        code, n = have.column("code").to_numpy().astype(np.uint32), have.column("n").to_numpy()
        cost = np.zeros((len(_LOW[token]), len(uniq)), dtype=np.float32)
        for i, (x, low) in enumerate(_LOW[token].items()):
            own = np.flatnonzero(label == x)
            cost[i] = Trie(code[own], n[own], low).costs_of(uniq)
        ends = np.cumsum([0, *map(len, asked)])
        blobs = [np.ascontiguousarray(cost[:, inv[a:b]]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"bucket": want.column("bucket"), "chunk": want.column("chunk"), "c": pa.array(blobs, pa.binary())})

    return run


def answers(chunks: DataFrame, counts: DataFrame, low: dict[str, tuple[np.ndarray, np.ndarray]], buckets: int, token: str) -> DataFrame:
    """(bucket, chunk, c): for the strings that each of ``chunks`` (chunk, text) has in a bucket,
    their costs as 32-bit floats, label by label in the order of ``low``."""
    asked = chunks.groupBy("chunk").applyInArrow(_ask(buckets), "bucket int, chunk int, codes binary")
    held = counts.withColumn("bucket", F.expr(f"cast((shiftright(code, 8) & 65535) % {buckets} as int)"))
    sent = chunks.sparkSession.sparkContext.broadcast(low)
    return held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_answer(token, sent), "bucket int, chunk int, c binary")


class Trie:
    """A frozen trie; ``low`` gives orders 0 and 1 where ``code`` doesn't hold all strings."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: list[dict[int, tuple[np.ndarray, np.ndarray]]] | None = None):
        order = np.argsort(code)
        self.code, self.n = code[order].astype(np.uint32), n[order].astype(np.float64)
        low = low or [_kids(self.code, self.n, k) for k in range(2)]
        self.kids = [*low, *(_kids(self.code, self.n, k) for k in (2, 3))]  # by order 0..3: symbols and counts by context
        self.slow: dict[int, float] = {}

    def seen(self) -> np.ndarray:
        """Costs of the trie's own strings."""
        if not len(self.code):
            return np.zeros(0)
        ctx = self.code >> np.uint32(8)
        heads = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
        size = np.diff(np.append(heads, len(ctx)))
        return np.log10(self.n / (np.repeat(np.add.reduceat(self.n, heads), size) + np.repeat(size, size)))

    def costs_of(self, want: np.ndarray) -> np.ndarray:
        """Costs of distinct strings."""
        out = np.full(len(want), np.nan)
        if len(self.code):
            at = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            hit = self.code[at] == want
            out[hit] = self.seen()[at[hit]]
        bad = np.flatnonzero(np.isnan(out))
        out[bad] = [self.cost(int(x)) for x in want[bad]]
        return out

    def cost(self, code: int) -> float:
        """log10 probability of a string's last byte after its first three, by the definition."""
        if code in self.slow:
            return self.slow[code]
        p, out, sym = 1.0, np.zeros(256, dtype=bool), code & 0xFF
        for k in (3, 2, 1, 0):
            kids = self.kids[k].get((code >> 8) & ((1 << 8 * k) - 1))
            if kids is None:
                continue
            live = ~out[kids[0]]
            syms, n = kids[0][live], kids[1][live]
            if not len(syms):
                continue
            total = float(n.sum()) + len(syms)
            if (at := np.flatnonzero(syms == sym)).size:
                p *= float(n[at[0]]) / total
                break
            p *= len(syms) / total
            out[syms] = True
        else:
            p /= max(1, 256 - int(out.sum()))
        if len(self.slow) > 1 << 20:
            self.slow.clear()
        self.slow[code] = value = float(np.log10(p))
        return value

class Model(Trie):
    """A trie of all strings with a table of costs (log10 probabilities) of those met so far."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        super().__init__(code, n)
        code, n = self.code, self.n
        pair1, pair2 = code >> np.uint32(16), code & np.uint32(0xFFFF)
        self.row, self.col = self._rank(pair1, n), self._rank(pair2, n)
        self.width = int(self.col.max(initial=0)) + 1
        self.table = np.full((int(self.row.max(initial=0)) + 1) * self.width, np.nan, dtype=np.float32)
        if len(code):
            r, c = self.row[pair1], self.col[pair2]
            ok = (r > 0) & (c > 0)
            self.table[r[ok] * self.width + c[ok]] = self.seen()[ok]

    @staticmethod
    def _rank(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 16, dtype=np.int64)
        weight = np.bincount(pair.astype(np.int64), n, 1 << 16)
        top = np.argsort(-weight, kind="stable")[:SIDE]
        top = top[weight[top] > 0]
        out[top] = np.arange(1, len(top) + 1)
        return out

    def costs(self, buf: np.ndarray) -> np.ndarray:
        """Cost of the byte at each position from 3 on."""
        pair = (buf[:-1].astype(np.uint16) << np.uint16(8)) | buf[1:]
        r, c = self.row[pair[:-2]], self.col[pair[2:]]
        at = r * self.width + c
        out = self.table[at]
        bad = np.flatnonzero(np.isnan(out))
        if len(bad):
            b = buf.astype(np.uint32)
            want = (b[bad] << 24) | (b[bad + 1] << 16) | (b[bad + 2] << 8) | b[bad + 3]
            uniq, inv = np.unique(want, return_inverse=True)
            value = np.array([self.cost(int(x)) for x in uniq], dtype=np.float32)
            out[bad] = value[inv]
            keep = (r[bad] > 0) & (c[bad] > 0)
            self.table[at[bad[keep]]] = out[bad[keep]]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text and its end."""
        buf, start = padded(data, offsets)
        if len(offsets) < 2:
            return np.zeros(0)
        return _sums(self.costs(buf[:-2]), start, offsets)
