"""Embedding whitening against numpy's eigen solver and exact integers."""

from __future__ import annotations

import os

import numpy as np
import pytest

from regolith.llm import queries as Q
from regolith.llm.whitening import components, fit_whitening, identity_error, valid_vectors, whitened

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def spread(kind, d, rng):
    return {
        "mixed": rng.random(d) * 100,
        "equal": np.ones(d),
        "two": np.repeat([5.0, 2.0], [d // 2, d - d // 2]),
        "steep": 10.0 ** (-rng.random(d) * 12),
        "one": np.r_[1e6, np.ones(d - 1)],
        "pairs": np.repeat(1.0 + np.arange(-(-d // 2)), 2)[:d],
    }[kind]


@pytest.mark.parametrize("kind", ["mixed", "equal", "two", "steep", "one", "pairs"])
@pytest.mark.parametrize("d", [1, 2, 3, 8, 64])
def test_spectral_splits_equal_numpy(kind, d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * spread(kind, d, rng)) @ q.T
    a = (a + a.T) / 2
    e, v = components(a)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
    assert np.linalg.norm(a @ v - v * e) <= 1e-12 * want[0]


def test_query_equals_brute_force(spark):
    rows = Q.table(spark, SF, "embeddings").collect()
    x = {r.vec_id: np.floor(np.array(r.embedding, dtype=np.float64) * 64).astype(np.int64) + 1_000_000 for r in rows}
    m = np.array(list(x.values()))
    n, s = len(m), m.sum(axis=0)
    c = m - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    got = Q.op13_embedding_whitening(spark, SF).toPandas()
    assert len(got) == 32 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-8
    for i, g in got.groupby("component"):
        y = np.array([((x[k] - s / n) @ v[:, i - 1]) / np.sqrt(e[i - 1]) for k in g.vec_id])
        assert np.allclose(g.whitened * np.sign(g.whitened.to_numpy() @ y), y, atol=1e-7)
        assert np.allclose(g.explained, e[i - 1] / e.sum(), rtol=1e-9)
    exact = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for k, r in x.items()}
    assert all(exact[k] == d for k, d in zip(got.vec_id, got.deviation, strict=True))


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"Label string, vec_id long, embedding {kind}, label int")


def test_rows_left_out_and_kept(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [("x", i, rng.standard_normal(3).tolist(), 0) for i in range(40)]
    odd = [("x", 100, None, 1), ("x", 101, [], 1), ("x", 102, [1.0, None, 2.0], 1), ("x", 103, [nan, 1.0, 2.0], 1), ("x", 104, [1.0, -inf, 2.0], 1), ("x", 105, [1.0, 2.0], 1)]
    more = [(None, None, [0.5, 0.25, 1.0], None), ("x", 7, good[7][2], None)]
    rows = valid_vectors(frame(spark, good + odd + more), "vec_id", "embedding")
    assert rows.count() == 42
    model = fit_whitening(rows, 2)
    assert model.n == 42 and len(model.values) == 2 and identity_error(rows, model) < 1e-12
    out = whitened(rows, model).collect()
    assert sorted(str(r.id) for r in out) == sorted(str(r[1]) for r in good + more) and all(len(r.whitened) == 2 for r in out)
    assert len({tuple(r.whitened) for r in out if r.id == 7}) == 1


@pytest.mark.parametrize("rows", [[], [("x", 1, [1.0, 2.0], 0)], [("x", i, [1.0, 2.0], 0) for i in range(9)], [("x", 1, None, 0)]])
def test_no_variance_gives_no_component(spark, tmp_path, rows):
    frame(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.op13_embedding_whitening(spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_flat_dimension_and_equal_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [("x", i, [*rng.standard_normal(2).tolist(), 4.0], 0) for i in range(50)]
    rows += [("x", 50 + i, rng.standard_normal(2).tolist(), 0) for i in range(50)]
    kept = valid_vectors(frame(spark, rows), "vec_id", "embedding")
    assert kept.count() == 50
    model = fit_whitening(kept, 32)
    assert len(model.values) == 2 and identity_error(kept, model) < 1e-12
