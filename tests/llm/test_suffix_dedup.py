"""Repeated byte strings against plain sets; the transform against sorted suffixes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from regolith.llm.suffix_dedup import Column, repeats, suffix_dedup


def plain(rows, length):
    """Rows are (id, text) in order; one id is one document."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            x = b[i : i + length]
            if x in seen:
                gone[i : i + length] = True
            seen.add(x)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))[: len(b)]).sum()) if b else 0
        out.append((doc_id, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    df = spark.createDataFrame([(x, i, t, "TEXT") for i, (x, t) in enumerate(rows)], "doc_id long, Doc_Id int, text string, TEXT string")
    out = suffix_dedup(df, **how)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()), key=repr)


def test_columns_equal_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        segs = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        right = [rng.randint(0, 5) for _ in segs]
        column = Column(5)
        for j in range(20):
            symbols = np.array([x[len(x) - 1 - (j - r)] if 0 <= j - r < len(x) else 0 for x, r in zip(segs, right, strict=True)], dtype=np.uint8)
            column.insert(symbols, np.array([i for i, r in enumerate(right) if r == j], dtype=np.int64))
            live = {i: segs[i][len(segs[i]) - 1 - (j - right[i]) :] for i in range(len(segs)) if 0 <= j - right[i] < len(segs[i])}
            got = column.who.tolist()
            assert sorted(got) == sorted(live) and [live[i] for i in got] == sorted(live.values())
            common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert column.lcp.tolist() == [min(5, common(live[a], live[b])) if i else 0 for i, (a, b) in enumerate(zip([None, *got], got, strict=False))]


def test_repeats_of_aligned_segments():
    rng = random.Random(2)
    for _ in range(60):
        segs, to = [bytes(rng.choice(b"ab") for _ in range(rng.randint(6, 12))) for _ in range(rng.randint(1, 12))], []
        windows = np.array([len(x) - 5 for x in segs])
        to = np.array([rng.randint(n - 1, 8) for n in windows.tolist()])
        rank = np.array(rng.sample(range(50), len(segs)))
        seg, off = repeats(np.frombuffer(b"".join(segs), dtype=np.uint8), np.cumsum([len(x) for x in segs]), windows, to, rank, 6)
        every = [(x[o : o + 6], to[i] - o, rank[i], i, o) for i, x in enumerate(segs) for o in range(windows[i])]
        least = {}
        for w, c, r, _, _ in every:
            least[w, c] = min(r, least.get((w, c), r))
        assert sorted(zip(seg.tolist(), off.tolist(), strict=True)) == sorted((i, o) for w, c, r, i, o in every if r > least[w, c])


def corpus(rng, n):
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ü") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 5))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("how", [{"length": 8, "anchor": 3}, {"length": 12, "anchor": 12}, {"length": 8, "anchor": 2, "hot": 3, "collection": 7}, {"length": 30, "anchor": 5, "hot": 0}])
def test_equals_plain_sets(spark, how):
    rows = corpus(random.Random(how["length"]), 150)
    rows += [(7, rows[3][1]), (7, rows[7][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (9001, None), ((1 << 63) - 1, rows[8][1]), (-5, "ab" * 200), (9002, "a" * 900), (9003, "a" * 7), (9004, "")]
    want = plain(rows, how["length"])
    assert got(spark, rows, **how) == want and sum(r[2] for r in want) > 500


def test_production_lengths(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    shared, line = text(400), text(60)
    rows = [(i, text(150) + (shared if i % 3 == 0 else line) + text(120)) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)] + [(2000, "ñ" * 5000), (2001, "ñ" * 3000 + text(50)), (2002, text(99)), (2003, text(100) * 2)]
    assert got(spark, rows) == plain(rows, 100)
    assert got(spark, rows, hot=50) == plain(rows, 100)


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, part + "x" + part), (2, part[1000:90_000])]
    assert [r[1:4] for r in got(spark, rows)] == [(600_001, 300_000, 1), (89_000, 89_000, 1)]
    assert got(spark, []) == []
    with pytest.raises(ValueError, match="anchor"):
        got(spark, rows, length=10, anchor=11)


def test_run_that_repeats_itself(spark):
    rng = random.Random(7)
    unit = "".join(rng.choice("abcdefghij") for _ in range(37))
    rows = [(1, unit * 4), (2, "".join(rng.choice("klmnop") for _ in range(400))), (3, "q" * 101)]
    assert got(spark, rows) == plain(rows, 100) and got(spark, rows)[0][2] == 111
