"""Search of many phrases in one pass over the texts of an Arrow batch.

The phrases form an automaton: a trie whose failure links are folded into one dense table of next
states, over classes of the bytes that phrases use.  A batch's texts step through it side by side, one
byte of each a step, so a step is two array look-ups for all texts that are that long; longer texts go as
overlapping slices.  The result equals testing every phrase with ``contains``; its cost grows with the
text, not with the number of phrases.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Rules

SLICE = 2048


class Automaton:
    """``step[state, byte class]`` is the next state; a state's phrases are
    ``phrase[first[state] : first[state + 1]]``, those of its failure links included."""

    def __init__(self, phrases: Sequence[str]):
        raw = [p.encode() for p in phrases]
        if not all(raw):
            raise ValueError("an empty phrase is in every text")
        self.longest = max(map(len, raw), default=1)
        used = sorted({b for p in raw for b in p})
        self.of_byte = np.zeros(256, dtype=np.int32)
        self.of_byte[used] = np.arange(1, len(used) + 1)
        trie, ends = [{}], [[]]
        for i, p in enumerate(raw):
            at = 0
            for b in p:
                if b not in trie[at]:
                    trie[at][b] = len(trie)
                    trie.append({})
                    ends.append([])
                at = trie[at][b]
            ends[at].append(i)
        self.step = np.zeros((len(trie), len(used) + 1), dtype=np.int32)
        fail, queue = [0] * len(trie), deque([0])
        while queue:
            at = queue.popleft()
            if at:
                ends[at] = ends[at] + ends[fail[at]]
                self.step[at] = self.step[fail[at]]  # of a shorter suffix, thus complete
            for b, to in trie[at].items():
                fail[to] = int(self.step[at, self.of_byte[b]])
                self.step[at, self.of_byte[b]] = to
                queue.append(to)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in ends]))).astype(np.int64)
        self.phrase = np.array([i for x in ends for i in x], dtype=np.int64)
        self.size = len(raw)

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, phrase) pairs, ascending."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, off, data = texts.buffers()
        off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or off[-1] == off[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = self.of_byte[np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]]
        off = off - off[0]
        stride = SLICE - self.longest + 1 if self.longest < SLICE // 2 else SLICE
        parts = np.maximum(1, -(-np.diff(off) // stride))
        row = np.repeat(np.arange(len(texts)), parts)
        start = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * stride
        size = np.minimum(off[row + 1], start + stride + self.longest - 1) - start
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # longer than each step
        state, flat, width = np.zeros(len(row), dtype=np.int32), self.step.reshape(-1), self.step.shape[1]
        some = np.diff(self.first) > 0
        found_row, found_state = [], []
        for j, k in enumerate(live.tolist()):
            state = flat[state[:k] * width + data[start[:k] + j]]
            hit = np.flatnonzero(some[state])
            if len(hit):
                found_row.append(row[hit])
                found_state.append(state[hit])
        if not found_row:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.unique(np.concatenate(found_row) * len(self.step) + np.concatenate(found_state))
        row, at = np.divmod(key, len(self.step))
        n = self.first[at + 1] - self.first[at]
        ids = self.phrase[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        key = np.unique(np.repeat(row, n) * self.size + ids)
        return np.divmod(key, self.size)


@cache
def automaton(phrases: tuple[str, ...]) -> Automaton:
    return Automaton(phrases)


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def label_counts(row: np.ndarray, phrase: np.ndarray, n: int, phrases: Sequence[str], rules: Rules) -> np.ndarray:
    """How many of each label's phrases each text has."""
    number = {p: i for i, p in enumerate(phrases)}
    has = np.zeros((len(phrases), len(rules)), dtype=np.int32)
    for j, (_, own) in enumerate(rules):
        for p in own:
            has[number[p], j] += 1
    out = np.zeros((n, len(rules)), dtype=np.int32)
    np.add.at(out, row, has[phrase])
    return out


def all_of(*tables: Rules) -> tuple[str, ...]:
    """Every phrase of some tables."""
    return tuple(dict.fromkeys(x for t in tables for _, p in t for x in p))


def frozen(rules: Rules) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((label, tuple(p)) for label, p in rules)


def search(text: Column, phrases: Sequence[str], ranked: Rules = (), counted: Rules = ()) -> Column:
    """(found, ranked, counts) of lower-case texts, whose phrases are among ``phrases``.

    ``found``: the distinct phrases in the text, in their order.  ``ranked``: labels of that table with a
    phrase in the text, most phrases first, table order on ties.  ``counts``: phrases found of each label of
    that table.  A null text has no phrases."""
    phrases, ranked, counted = tuple(dict.fromkeys(phrases)), frozen(ranked), frozen(counted)
    automaton(phrases)  # raises here, not in a task
    labels = np.array([label for label, _ in ranked], dtype=object)

    @F.arrow_udf("struct<found: array<string>, ranked: array<string>, counts: array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        n = len(texts)
        row, phrase = automaton(phrases).pairs(texts)
        found = _lists(row, pa.array(np.array(phrases, dtype=object)[phrase], pa.string()), n)
        count = label_counts(row, phrase, n, phrases, ranked)
        order = np.argsort(-count, axis=1, kind="stable")
        r, c = np.nonzero(np.take_along_axis(count, order, axis=1))
        best = _lists(r, pa.array(labels[order[r, c]], pa.string()), n)
        count = label_counts(row, phrase, n, phrases, counted)
        counts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(counted)), pa.array(count.reshape(-1), pa.int32()))
        return pa.StructArray.from_arrays([found, best, counts], ["found", "ranked", "counts"])

    return run(text)


def found(text: Column, phrases: Sequence[str]) -> Column:
    """The distinct phrases that a lower-case text contains, in their order; of null, none."""
    return search(text, phrases)["found"]


def ranked(text: Column, rules: Rules) -> Column:
    """Labels with at least one phrase in a lower-case text, most phrases first, table order on ties."""
    return search(text, all_of(rules), ranked=rules)["ranked"]


def first(text: Column, phrases: Sequence[str]) -> Column:
    """The first of ``phrases``, in their order, that a lower-case text contains, else null."""
    return F.get(found(text, phrases), 0)


def literal(phrases: Iterable[str]) -> Column:
    return F.array(*map(F.lit, phrases)).cast("array<string>")


def of(hits: Column, phrases: Sequence[str]) -> Column:
    """Those of ``phrases`` that are among found ones, in their order."""
    return F.array_intersect(literal(phrases), hits)
