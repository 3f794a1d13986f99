"""Whitened vectors by an incremental eigendecomposition.

Every task keeps the eigenvectors and eigenvalues of the centred scatter of the
rows it has seen and brings new rows in by rank-one updates: the eigenvalues move
to the roots of the secular equation ``1 + sum(z_j**2 / (d_j - m)) = 0``, after
entries that do not couple and equal eigenvalues have been deflated.  A block of
more rows than dimensions goes in as the rows of its triangular factor, which have
the same scatter, and one more row for the shift of the mean; so a row costs its
share of a QR step, and a block as many secular equations as there are dimensions.

Tasks' spectra are combined in levels by the same rank-one updates.  At last all
rows are projected on the basis found, once more in tasks, and the small projected
scatter gives the refined vectors (Rayleigh-Ritz over the whole basis, so rounding
of thousands of updates is undone).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.vectors import combined, matrix, whole_vectors
from gradewell.session import materialize

_EPS = np.finfo(np.float64).eps
#: Rows brought in at once.
BLOCK = 4096
_STEPS = 100


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - m))`` for strictly ascending ``d`` and positive ``z2``.

    Each root lies between a ``d`` and the next, the last one at most the sum of
    ``z2`` above the last.  Returned as the ``d`` it is closer to and the way from
    there, so that differences to all ``d`` keep their leading digits.
    """
    n = len(d)
    k = np.arange(n)
    gap = np.append(np.diff(d), z2.sum())

    def value(origin: np.ndarray, way: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return (d[None, :] - d[origin][:, None]) - way[:, None]

    middle = 1 + (z2 / value(k, gap / 2)).sum(axis=1)
    right = (middle < 0) & (k < n - 1)
    origin = np.where(right, k + 1, k)
    lo = np.where(right, -gap / 2, 0.0)
    hi = np.where(right, 0.0, np.where(k < n - 1, gap / 2, gap))
    lo[-1], hi[-1] = (gap[-1] / 2, gap[-1]) if middle[-1] < 0 else (0.0, gap[-1] / 2)
    way = (lo + hi) / 2
    below = k[None, :] <= k[:, None]
    # The poles beside a root; the last root has only one, and a far one takes the place of the other.
    left = d - d[origin]
    next_ = np.append(d[1:], d[-1] + 4 * gap[-1]) - d[origin]
    for _ in range(_STEPS):
        away = value(origin, way)
        terms = z2 / away
        slopes = terms / away
        psi, phi = np.where(below, terms, 0).sum(axis=1), np.where(below, 0, terms).sum(axis=1)
        f = 1 + psi + phi
        lo, hi = np.where(f < 0, way, lo), np.where(f < 0, hi, way)
        done = np.abs(f) <= 4 * _EPS * n * (1 + np.abs(psi) + phi)
        if (done | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))).all():
            break
        # Both sums are replaced by a pole each with the same value and slope; the root of that is the next place.
        dpsi, dphi = np.where(below, slopes, 0).sum(axis=1), np.where(below, 0, slopes).sum(axis=1)
        a, b = left - way, next_ - way
        p, q = dpsi * a * a, dphi * b * b
        c = f - dpsi * a - dphi * b
        # c + p / (a - s) + q / (b - s) = 0
        two, one, zero = c, -(c * (a + b) + p + q), c * a * b + p * b + q * a
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(one * one - 4 * two * zero, 0))
            s = np.where(one <= 0, 2 * zero / (root - one), (-one - root) / (2 * two))
        new = way + s
        good = np.isfinite(new) & (new > lo) & (new < hi)
        way = np.where(done, way, np.where(good, new, (lo + hi) / 2))
    return origin, way


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors @ diag(values) @ vectors.T + u @ u.T``."""
    z = u @ vectors
    scale = max(abs(values[-1]), float(z @ z))
    if scale == 0:
        return values, vectors
    # Equal eigenvalues: one reflection turns all of a group's weight to its last vector.
    bounds = np.flatnonzero(np.diff(values) > 8 * _EPS * scale) + 1
    if len(bounds) + 1 < len(values):
        vectors = vectors.copy()
        for a, b in zip(np.append(0, bounds), np.append(bounds, len(values))):
            if b - a > 1 and (z[a: b - 1] ** 2).sum() > 0:
                w = z[a:b].copy()
                norm = np.sqrt(w @ w)
                w[-1] += norm if w[-1] >= 0 else -norm
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ w, w) * (2 / (w @ w))
                z[b - 1] = -norm if z[b - 1] >= 0 else norm
                z[a: b - 1] = 0
    live = np.abs(z) * np.sqrt(scale) > 8 * _EPS * scale
    if not live.any():
        return values, vectors
    d, weights = values[live], z[live]
    origin, way = secular_roots(d, weights * weights)
    moved = d[origin] + way
    away = (d[None, :] - d[origin][:, None]) - way[:, None]  # (root, pole)
    # Weights for which these roots are exact: the vectors come out orthogonal (Gu and Eisenstat).
    n = len(d)
    ratio = away.T.copy()  # (pole j, root i): d_j - m_i
    if n > 1:
        below = d[:, None] - d[None, :]
        den = np.empty((n, n))
        low, up = np.tril(np.ones((n, n), bool), -1), np.triu(np.ones((n, n), bool))
        den[low] = below[low]  # d_j - d_i for roots before j
        den[:, :-1][up[:, :-1]] = np.delete(below, 0, axis=1)[up[:, :-1]]  # and d_j - d_(i+1) for roots from j on
        den[:, -1] = 1
        weight2 = -np.prod(ratio / den, axis=1)
        exact = np.sqrt(np.maximum(weight2, 0)) * np.sign(weights)
    else:
        exact = weights
    turned = exact[None, :] / away
    turned /= np.sqrt((turned * turned).sum(axis=1))[:, None]
    values, new = values.copy(), vectors.copy()
    values[live] = moved
    new[:, live] = vectors[:, live] @ turned.T
    order = np.argsort(values, kind="stable")
    return values[order], new[:, order]


@dataclass
class Spectrum:
    """Number, mean, and the eigenvalues (ascending) and eigenvectors of the centred scatter of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def _raise(self, u: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, u)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        """Takes in the mean of ``n`` rows whose own scatter is, or will be, added apart."""
        apart = mean - self.mean
        if self.n:
            self._raise(apart * np.sqrt(self.n * n / (self.n + n)))
        self.mean = self.mean + apart * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        """Brings rows in: one by one, or a block of more rows than dimensions by its triangular factor."""
        rows = rows.astype(np.float64)
        if len(rows) <= rows.shape[1]:
            for row in rows:
                self._shift(1, row)
        else:
            mean = rows.mean(axis=0)
            for row in np.linalg.qr(rows - mean, mode="r"):
                self._raise(row)
            self._shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._raise(vector * np.sqrt(value))
        if other.n:
            self._shift(other.n, other.mean)

    def parts(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return self.n, self.mean, self.values, self.vectors


def _spectra(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum.none(dims)
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            for at in range(0, len(x), BLOCK):
                own.add(x[at: at + BLOCK])
        if own.n:
            yield _result(TaskContext.get().partitionId(), own.parts())
    return run


def _result(part: int, payload: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(payload)], pa.binary())], ["part", "payload"])


def _merge_spectra(payloads: list[bytes]) -> bytes:
    first, *others = (Spectrum(*pickle.loads(p)) for p in payloads)
    for other in others:
        first.merge(other)
    return pickle.dumps(first.parts())


def _scatters(mean: np.ndarray, basis: np.ndarray):
    """Scatter of rows less ``mean``, projected on the columns of ``basis``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, seen = np.zeros((basis.shape[1] + 1,) * 2), False
        for batch in batches:
            x = matrix(batch.column("x"), len(mean))
            for at in range(0, len(x), BLOCK):
                y = (x[at: at + BLOCK] - mean) @ basis
                y = np.concatenate((y, np.ones((len(y), 1))), axis=1)
                own += y.T @ y
                seen = True
        if seen:
            yield _result(TaskContext.get().partitionId(), own)
    return run


def _sum_arrays(payloads: list[bytes]) -> bytes:
    return pickle.dumps(sum(pickle.loads(p) for p in payloads))


def _covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the projected rows, with what ``mean`` is off taken out."""
    found = pickle.loads(combined(fit.mapInArrow(_scatters(mean, basis), "part long, payload binary"), _sum_arrays))
    off = found[:-1, -1] / n
    return found[:-1, :-1] / n - np.outer(off, off)


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(columns: list[str], sums: list[int], n: int, basis: np.ndarray, values: np.ndarray, explained: np.ndarray, off: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / n for s in sums])
        k = len(values)
        for batch in batches:
            x = matrix(batch.column("x"), len(sums))
            for at in range(0, len(x), BLOCK):
                own = x[at: at + BLOCK]
                # Exact whatever their size: beyond 64 bits Python's integers take over.
                far = n * max(abs(int(own.max(initial=0))), abs(int(own.min(initial=0)))) + max(abs(s) for s in sums)
                large = far * far * len(sums) >= 2**63
                apart = own.astype(object) * n - np.array(sums, object) if large else own * n - np.array(sums, np.int64)
                deviation = [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1).tolist()]
                white = ((own - mean) @ basis) / np.sqrt(values)
                rows = np.repeat(np.arange(at, at + len(own)), k)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(pa.array(rows)) for c in columns],
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(rows), n)),
                    pa.array(deviation, pa.int64()).take(pa.array(rows - at)), pa.array(white.reshape(-1)),
                    pa.array(np.tile(explained, len(own))), pa.array(np.full(len(rows), off)),
                ], [*columns, *[f.split()[0] for f in _OUT.split(", ")]])
    return run


def whiten(rows: DataFrame, *keep: str, vector: str = "embedding", components: int = 4) -> DataFrame:
    """Whitened leading components of all whole vectors, one row a vector and component.

    ``keep``: columns returned beside ``component`` (from 1, by falling
    eigenvalue), ``n`` (distinct vectors), ``deviation`` (squared distance from the
    sums times ``n``, exact; null where no long holds it), ``whitened``,
    ``explained`` (share of the variance) and ``identity_error`` (what the
    covariance of the whitened distinct vectors is off the identity at most).
    Mean and covariance are those of the distinct vectors of whole numbers.

    Vectors that are null, hold null or non-finite entries or have another length
    than that of the smallest id are left out.  Components without variance, as
    with one distinct vector, have no whitened form and give no row; nor does an
    empty table.  Repeated rows are returned as often as they occur.
    """
    whole, total, dims = whole_vectors(rows, vector, *keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in whole.drop("x").schema], _OUT])
    nothing = whole.sparkSession.createDataFrame([], schema)
    if not total or not dims:
        return nothing
    fit = materialize(whole.select("x").distinct(), label="distinct-vectors")
    n, *sums = fit.select(F.count(F.lit(1)), *[F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dims)]).first()
    sums = [int(s) for s in sums]
    mean = np.array([s / n for s in sums])
    found = Spectrum(*pickle.loads(combined(fit.mapInArrow(_spectra(dims), "part long, payload binary"), _merge_spectra)))
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    ritz = _covariance(fit, mean, basis, n)
    values, turn = np.linalg.eigh(ritz)
    trace, values, turn = np.trace(ritz), values[::-1], turn[:, ::-1]
    k = int((values[:components] > 1e-13 * max(trace, 0)).sum()) if trace > 0 else 0
    if not k:
        return nothing
    basis, values = basis @ turn[:, :k], values[:k]
    off = np.abs(_covariance(fit, mean, basis / np.sqrt(values), n) - np.eye(k)).max()
    run = _projected(list(keep), sums, n, basis, values, values / trace, float(off))
    return whole.mapInArrow(run, schema)
