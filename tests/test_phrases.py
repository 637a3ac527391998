"""The one-pass phrase search against testing each phrase."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from regolith.functions import phrases as S
from regolith.functions import rules as R

TABLES = {
    "rules": S.all_of(R.CATEGORY, R.FAILURE_MODE, tuple(R.EVIDENCE.items())),
    "nested": ("a", "ab", "abc", "b", "bc", "cab", "abcab"),
    "marks": ("class i", "class ii", "510(k)", "a.b", "a+b", "x|y", "$1", "\\d", "é", "lion's mane", "^", "[z]", "tab\tin"),
    "one": ("recall",),
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_equals_contains(spark, name):
    phrases, rng = TABLES[name], random.Random(name)
    letters = sorted({c for p in phrases for c in p})
    texts = [None, "", *("".join(rng.choice([rng.choice(phrases), rng.choice(letters), rng.choice(phrases)[:3], " "]) for _ in range(rng.randint(1, 12))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    rows = df.select("t", S.found(F.col("t"), phrases).alias("f"), S.of(S.found(F.col("t"), phrases), phrases[::-1]).alias("o"), S.first(F.col("t"), phrases).alias("x")).collect()
    for r in rows:
        want = {p for p in phrases if p in (r.t or "")}
        assert r.f == [p for p in dict.fromkeys(phrases) if p in want]
        assert r.o == [p for p in dict.fromkeys(phrases[::-1]) if p in want]
        assert r.x == next((p for p in phrases if p in want), None)


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(3)
    phrases = ("needle in hay", "x" * 40, "hay")
    texts = ["".join(rng.choice(["hay ", "needle in ", "x" * rng.randint(1, 60), "é "]) for _ in range(rng.randint(0, 1500))) for _ in range(60)]
    texts += ["-" * (S.SLICE - k) + "needle in hay" for k in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for r in df.select("t", S.found(F.col("t"), phrases).alias("f")).collect():
        assert r.f == [p for p in phrases if p in r.t]


def test_phrases_longer_than_a_slice(spark):
    long = "ab" * S.SLICE
    r = spark.createDataFrame([("zz" + long + "z",), (long[:-1],)], "t string").select(S.found(F.col("t"), (long, "b")).alias("f")).collect()
    assert [x.f for x in r] == [[long, "b"], ["b"]]


def test_no_phrases(spark):
    assert spark.range(1).select(S.found(F.lit("x"), ()).alias("f")).first().f == []
    with pytest.raises(ValueError, match="empty"):
        S.found(F.lit("x"), ("a", ""))


def test_ranked_labels(spark):
    rules = [("one", ["a"]), ("two", ["b", "c"]), ("three", ["c", "d"])]
    rank = lambda t: spark.range(1).select(S.ranked(F.lit(t), rules).alias("x")).first().x
    assert rank("c a") == ["one", "two", "three"] and rank("d c") == ["three", "two"] and rank("-") == []
