"""Large ids in the n-gram join; steps of the classifier under a negative bracket."""

from __future__ import annotations

import numpy as np
import pytest

from regolith.llm.ngram_join import keep_one, ngram_join
from regolith.llm.quality_classifier import PULinear

A, B = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df).collect()), key=repr)


def test_ids_of_any_long(spark):
    big, last, low = (1 << 62) + 5, (1 << 63) - 1, -(1 << 63)
    assert joined(spark, [(big, A), (last, A), (low, B), (7, B)]) == sorted([(big, 4, big), (last, 4, big), (low, 2, low), (7, 2, low)], key=repr)
    rows = [(big, A), (None, A), (last, B), (None, "x y"), (None, "x y")]
    assert joined(spark, rows) == sorted([(big, 4, big), (None, 4, big), (last, 2, last), (None, 1, None), (None, 1, None)], key=repr)
    df = spark.createDataFrame([(big, A), (last, A), (None, B), (None, B)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in keep_one(df).collect()), key=repr) == sorted([(big, A), (None, B), (None, B)], key=repr)
    with pytest.raises(ValueError, match="2\\^63"):
        joined(spark, [(last, A), (low, A), (None, A)])


def test_a_negative_bracket_is_brought_to_zero_and_steps_go_on():
    rng = np.random.default_rng(3)
    cuts = [np.linspace(-1, 1, 7) for _ in range(4)]
    good, bad = rng.normal(0.8, 0.4, (400, 4)), rng.normal(-0.8, 0.4, (12_000, 4))
    unl = np.vstack((rng.normal(0.8, 0.4, (8_000, 4)), bad)).astype(np.float32)
    model = PULinear(None, cuts).start(good.astype(np.float32), unl[::4], 0.4)
    bp, inverse, u = model.bins(good.astype(np.float32)), np.linalg.inv(model.curvature(unl[::4])), lambda: model.unlabelled(model.bins(unl))
    # a prior above the true share makes the bracket negative at this fit
    prior = next(p for p in np.arange(0.4, 1.0, 0.01) if model.risk(bp, u(), p)[1] < -1e-3)
    seen = [model.newton(bp, u(), prior, inverse) for _ in range(6)]
    assert seen[0] < -1e-3 and max(seen[1:]) > seen[0] / 2 and all(abs(b) < abs(seen[0]) + 0.05 for b in seen)
    z = model.logit(unl)
    assert (z[:8_000] > 0).mean() > 0.9 and (z[8_000:] > 0).mean() < 0.2
