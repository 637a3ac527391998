"""Embedding whitening by QDWH spectral divide and conquer.

Method
------
1. Two passes over the vectors: exact sums, then the Gram matrix of the centred vectors.  Each
   task sends one partial row a dimension; nothing but ``d`` sums and ``d * d`` products reaches
   the driver, whatever the number of vectors.
2. There the covariance is split: the polar factor ``U`` of ``A - shift * I`` (QR-based dynamically
   weighted Halley iteration) gives the spectral projector ``(U + I) / 2`` of the eigenvalues
   above the shift; an orthonormal basis of its range and of the complement turns ``A`` into two
   smaller blocks, which are split again until a block is one component (or a multiple of the
   identity).  Two steps of a symmetric refinement made of products alone bring the collected
   basis to double precision.
3. Basis and mean (``d * m`` doubles) go to the tasks, which project batch by batch.

Defined results: vectors that are null, empty, or hold null, NaN or infinite entries are left
out, and so are vectors of another length than the most frequent one (of equally frequent, the
longest); ids may be null or repeated, each row is a vector of its own; components with no
variance (eigenvalue not above ``d`` roundings of the largest) have no whitened value and do not
count, so equal vectors or a single one give no component; of equal eigenvalues any orthonormal
basis is taken; an empty table gives an empty result; other columns are ignored.  Vectors may be
long: memory is ``d * d`` doubles a task and the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import required

_EPS = float(np.finfo(np.float64).eps)
_BATCH = 4096


@dataclass(frozen=True)
class Whitening:
    """Fit of ``n`` vectors: exact ``sums`` where entries are integers, the ``trace`` of their
    covariance, its falling eigenvalues ``values`` and unit eigenvectors ``vectors`` (columns)."""

    n: int
    sums: list
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=np.float64)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    rows = required(df, id_col, vector_col).toDF("id", "vector").where(usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (most.d if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(project: Callable[[np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vector"))
                x = project(x) if project else x
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()])], ["n", "total"])

    return run


def _gram(project: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for a in range(0, b.num_rows, _BATCH):
                y = project(_matrix(b.column("vector").slice(a, _BATCH)))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def column_sums(rows: DataFrame, kind: str, project: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[int, list]:
    """Number of vectors and sum of each dimension; one partial row a task."""
    part = rows.select("vector").mapInArrow(_sums(project), f"n long, total array<{kind}>")
    got = part.select("n", F.posexplode("total").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()
    return (got[0].n if got else 0), [r.x for r in got]


def scatter(rows: DataFrame, d: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over vectors of the outer product of their projection (centred by the caller)."""
    part = rows.select("vector").mapInArrow(_gram(project), "i int, row array<double>")
    out = np.zeros((d, d))
    for r in part.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r.i, r.j] = r.x
    return (out + out.T) / 2


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by the QR-based weighted Halley iteration."""
    d = len(a)
    size = np.linalg.norm(a)
    x = a / size
    low = max(1 / (np.linalg.norm(np.linalg.pinv(x)) or 1), _EPS)
    eye = np.eye(d)
    for _ in range(40):
        far = (4 * (1 - low * low) / low**4) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + far)
        wa = root + np.sqrt(8 - 4 * far + 8 * (2 - low * low) / (low * low * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))[0]
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if moved <= 4 * _EPS ** (1 / 3) and low > 1 - 10 * _EPS or moved <= 10 * _EPS * d:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if no shift parts them."""
    d = len(a)
    diagonal = np.sort(np.diag(a))
    middle = np.trace(a) / d
    spread = np.linalg.norm(a - middle * np.eye(d), 2)
    best = None
    for shift in (float(np.median(diagonal)), middle, *(middle + t * spread for t in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3, 0.6, -0.6))):
        u = polar(a - shift * np.eye(d))
        p = (u + u.T + 2 * np.eye(d)) / 4
        k = round(float(np.trace(p)))
        if not 0 < k < d or np.linalg.norm(p @ p - p) > 0.1:
            continue
        q = np.linalg.qr(p @ np.random.default_rng(d).standard_normal((d, k)))[0]
        q = np.linalg.qr(p @ q, mode="complete")[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 100 * d * _EPS * scale:
            break
    return best[1:] if best else None


def spectral(a: np.ndarray, scale: float | None = None) -> np.ndarray:
    """Orthonormal basis in which the symmetric ``a`` is diagonal, by recursive splits."""
    d = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    if d == 1 or np.linalg.norm(a - np.trace(a) / d * np.eye(d)) <= d * _EPS * scale:
        return np.eye(d)
    parts = _split(a, scale)
    if parts is None:
        return np.eye(d)
    return np.hstack([v @ spectral((m := v.T @ a @ v, (m + m.T) / 2)[1], scale) for v in parts])


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors from a nearly diagonalising basis."""
    d = len(a)
    for _ in range(2):
        r = np.eye(d) - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.linalg.norm(s - np.diag(e)) + np.linalg.norm(a) * np.linalg.norm(r))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    for _ in range(2):
        x = x @ (3 * np.eye(d) - x.T @ x) / 2
    e = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues (falling) and unit eigenvectors of a covariance."""
    return refined(covariance, spectral(covariance))


def centred(mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x - mean


def projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """Centre, project, scale to unit variance."""
    mean, basis = model.mean, model.vectors / np.sqrt(model.values)
    return lambda x: (x - mean) @ basis


def fit_whitening(rows: DataFrame, most: int) -> Whitening | None:
    """Fit on all of ``valid_vectors``; None without variance.  Sums of integers are exact."""
    whole = rows.schema["vector"].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    kind = "long" if whole else "double"
    rows = rows.select("id", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    n, sums = column_sums(rows, kind)
    if not n:
        return None
    mean = np.array([s / n for s in sums], dtype=np.float64)
    cov = scatter(rows, len(sums), centred(mean)) / n
    values, vectors = components(cov)
    m = min(most, int((values > len(values) * _EPS * max(values[0], 0)).sum()))
    return Whitening(n, sums, float(np.trace(cov)), values[:m], vectors[:, :m]) if m else None


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, vector, whitened): each row's unit-variance components."""
    project = projection(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, _BATCH):
                part = b.slice(a, _BATCH)
                y = project(_matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(y), pa.list_(pa.float64()))], [*part.schema.names, "whitened"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "vector").mapInArrow(run, f"id {kinds['id']}, vector {kinds['vector']}, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows."""
    project, m = projection(model), len(model.values)
    n, sums = column_sums(rows, "double", project)
    mean = np.array(sums) / n
    return float(np.abs(scatter(rows, m, lambda x: project(x) - mean) / n - np.eye(m)).max())
