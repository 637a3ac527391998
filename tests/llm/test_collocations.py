"""Phrase mining against plain counting, whatever the shards and slots."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from regolith.llm.collocations import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least, longest, top, percent=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    many = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = {(lang, p[i : i + n]) for (lang, p), g in many.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * g >= percent * many[lang, p[i : i + n]]}
    out = {}
    for (lang, p), a in many.items():
        if (lang, p) not in gone:
            s, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def got(df):
    assert df.columns == COLUMNS
    return {tuple(r) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, x, t, "y") for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, Text string")


TEXTS = [
    ("en", "New York is big. New York, new york city! the the the the"), ("en", "new\tyork  city hall; NEW YORK CITY HALL"), ("en", None), (None, "x y z x y z x y z"),
    ("en", ""), ("en", " .,;\n "), ("de", "größe Größe der größe der Größe"), ("en", "the the the the the"), ("en", "one"), (None, "x y\nz x y z"),
] * 3


@pytest.mark.parametrize(("shards", "slots", "longest", "least"), [(1, None, 3, 3), (4, 1, 3, 4), (3, 8, 4, 3)])
def test_equals_plain_counts(spark, shards, slots, longest, least):
    df = collocations(frame(spark, TEXTS), least=least, longest=longest, top=7, shards=shards, slots=slots)
    want = plain(TEXTS, least, longest, 7)
    assert want and got(df) == want


def test_ties_cut_by_phrase(spark):
    rows = [("en", f"a{i:02d} b{i:02d}. ") for i in range(40)] * 3
    assert got(collocations(frame(spark, rows), least=3, top=25)) == plain(rows, 3, 3, 25)


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [("en", "a b c")]):
        assert got(collocations(frame(spark, rows))) == set()


def test_one_text_and_one_phrase_hold_most(spark):
    long = " ".join(f"w{i % 700} v{i % 31}" for i in range(60_000))
    rows = [("en", long), *[("en", "same old words")] * 500, ("en", "x" * 300_000 + " y")]
    assert got(collocations(frame(spark, rows), top=300)) == plain(rows, 10, 3, 300)


def test_slots_are_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power of two"):
        collocations(frame(spark, TEXTS), slots=12)
