"""Answers asked once; budgets shared out by counts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from regolith.operators import answers as A


@pytest.mark.parametrize("budget", [0, 1, 7, 60, 61, 199, 200, 5000])
@pytest.mark.parametrize("most", [1, 5, 1000])
def test_budget_equals_a_sort(spark, budget, most):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 2, 5]), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), i) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, "a", -1)], "tier int, id string, i int").cache()
    got = sorted((r.tier, r.id) for r in A.within_budget(df, budget, most=most).collect())
    assert got == sorted(r[:2] for r in rows)[:budget]


def counting(folder):
    def client(prompt, key):
        with open(os.path.join(folder, key), "a") as f:
            f.write("x")
        return prompt.upper()

    return client


def test_nothing_is_asked_twice(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    client = counting(str(tmp_path / "calls"))
    book = A.AnswerBook(spark, str(tmp_path / "book"), buckets=4)
    rows = spark.createDataFrame([(i, f"text {i % 5}" if i != 9 else None) for i in range(12)], "id int, t string")
    variants = A.instructions({"short": "Shorten", "mood": "Rate"}, "t")
    assert book.answers(rows, "id", variants).where("answer is not null").count() == 0
    assert book.learn(A.prompts_of(rows, variants), client) == 12  # five texts and the blank one, two variants
    more = spark.createDataFrame([(50, "text 1"), (51, "fresh")], "id int, t string")
    assert book.learn(A.prompts_of(rows.unionByName(more), variants), client) == 2
    assert book.learn(A.prompts_of(more, variants), client) == 0
    calls = os.listdir(tmp_path / "calls")
    assert len(calls) == 14 and all((tmp_path / "calls" / c).read_text() == "x" for c in calls)
    got = {(r.id, r.variant): r.answer for r in book.answers(more, "id", variants).collect()}
    assert got == {(50, "short"): "SHORTEN\nTEXT 1", (50, "mood"): "RATE\nTEXT 1", (51, "short"): "SHORTEN\nFRESH", (51, "mood"): "RATE\nFRESH"}


def test_lost_before_the_commit_keeps_the_book(spark, tmp_path, monkeypatch):
    book = A.AnswerBook(spark, str(tmp_path), buckets=2)
    prompts = spark.createDataFrame([("v", "p")], "variant string, prompt string")
    with monkeypatch.context() as m:
        m.setattr(book.table.manifest, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            book.learn(prompts)
    assert book.table.read().count() == 0 and book.learn(prompts) == 1 and book.table.read().count() == 1


def test_null_prompts_are_not_asked(spark, tmp_path):
    book = A.AnswerBook(spark, str(tmp_path), buckets=2)
    assert book.learn(spark.range(3).select(F.lit("v").alias("variant"), F.lit(None).cast("string").alias("prompt"))) == 0
