"""Whitening of integer-scaled embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

An entry c becomes the whole number floor(scale * c) + shift, so sums are exact. Two passes gather the row count with the sums, and the scatter
of rows centred by them; each partition adds up one matrix, and a few tasks add those of the partitions, so what comes to the driver depends on the
dimension alone. The scatter over n is factored as L L' with the largest remaining diagonal entry first, until what remains is rounding. Plane rotations
make L's columns orthogonal: their squared norms are the eigenvalues and the columns, at unit length, the components. L L' is never formed again, so
small eigenvalues keep their relative precision. A third pass measures the whitened rows' covariance.

Rows whose vector is null, empty, or holds null or non-finite entries, or an entry whose whole number doesn't fit 53 bits, are dropped. Where lengths differ, vectors of the most frequent length (the
longest among equals) remain. Directions without variance have no component: a table of one row, or of equal rows, gives no rows, and so does an
empty one. Repeated rows and rows without an id count and are returned each. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxnframe.llm.common import lean

SCALE, SHIFT, MERGERS, EXACT = 1024, 100_000, 32, 1 << 53
EPS = float(np.finfo(float).eps)


def whole(batch: pa.RecordBatch, column: str, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths and flattened whole numbers of the valid vectors of a batch (of one length if given)."""
    col = batch.column(column)
    size = np.diff(np.asarray(col.offsets)).astype(np.int64)
    held = col.values.slice(int(col.offsets[0].as_py()), int(size.sum())).cast(pa.float64())
    x = np.floor(held.fill_null(float("nan")).to_numpy(zero_copy_only=False) * SCALE)
    bad = ~(np.abs(x) < EXACT)
    row = np.repeat(np.arange(len(size)), size)
    good = (np.bincount(row[bad], minlength=len(size)) == 0) & (size > 0) & np.asarray(col.is_valid())
    if width is not None:
        good &= size == width
    return np.flatnonzero(good), size[good], np.where(bad, 0, x).astype(np.int64)[good[row]] + SHIFT


def _added(parts: DataFrame, width: int, kind: str) -> np.ndarray:
    """Sum of the parts (bytes of equal arrays), by a few tasks first."""

    def run(batches):
        total = None
        for batch in batches:
            for raw in batch.column("raw"):
                x = np.frombuffer(raw.as_py(), kind)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["raw"])

    few = lean(parts.repartition(MERGERS)).mapInArrow(run, "raw binary").collect()  # MERGERS rows
    return sum((np.frombuffer(bytes(r[0]), kind) for r in few), np.zeros(width, kind))


class Whitening:
    """n, sums, eigenvalues (falling), components (unit columns) and the trace of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray):
        self.n, self.sums = n, sums
        cov = scatter / n
        self.trace = float(np.trace(cov))
        self.values, self.components = jacobi(*cholesky(cov))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n  # the numerator is exact

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ (self.components[:, :k] / np.sqrt(self.values[:k]))


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (rows in pivot order, as many columns as the rank) and the pivots, with L L' = a in that order."""
    a, n = a.copy(), len(a)
    pivot, low = np.arange(n), np.zeros((n, n))
    floor, rank = 0.0, 0
    for k in range(n):
        j = k + int(np.argmax(np.diag(a)[k:]))
        if k == 0:
            floor = a[j, j] * n * EPS
        if a[j, j] <= floor:
            break
        for x in (a, low):
            x[[k, j]] = x[[j, k]]
        a[:, [k, j]] = a[:, [j, k]]
        pivot[[k, j]] = pivot[[j, k]]
        low[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
        rank = k + 1
    return low[:, :rank], pivot


def jacobi(low: np.ndarray, pivot: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of low low' in the original order: low's columns made orthogonal by plane rotations, half of the columns paired with the others at once."""
    g, r = low.copy(), low.shape[1]
    ring = np.arange(r + r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(0, len(ring) - 1)):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) / np.sqrt(np.maximum(alpha * beta, np.finfo(float).tiny))
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > EPS
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])  # everyone meets everyone
        if worst <= 4 * EPS * np.sqrt(max(1, r)):
            break
    values = (g * g).sum(0)
    by = np.argsort(-values, kind="stable")
    vectors = np.zeros((len(low), r))
    vectors[pivot] = g[:, by] / np.sqrt(values[by])
    return values[by], vectors


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all valid vectors of the most frequent length; None without any."""
    held = df.select(vector)

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            _, size, x = whole(batch, vector)
            off = np.append(0, np.cumsum(size))
            for w in np.unique(size).tolist():
                rows = np.flatnonzero(size == w)
                s = x[off[rows][:, None] + np.arange(w)].sum(0)
                total[w] = total.get(w, 0) + np.append(len(rows), s)
        for w, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.int64()), pa.array([int(s[0])], pa.int64()), pa.array([s.astype(np.int64).tobytes()], pa.binary())], names=["width", "n", "raw"])

    parts = lean(held).mapInArrow(sums, "width long, n long, raw binary")
    best = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return None
    width = best["width"]
    total = _added(parts.filter(F.col("width") == width).select("raw"), width + 1, "<i8")
    n, s = int(total[0]), total[1:]

    def scatter(batches):
        out = np.zeros((width, width))
        for batch in batches:
            x = (n * whole(batch, vector, width)[2].reshape(-1, width) - s) / n
            out += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["raw"])

    return Whitening(n, s, _added(lean(held).mapInArrow(scatter, "raw binary"), width * width, "<f8").reshape(width, width))


def identity_error(df: DataFrame, model: Whitening, k: int, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity. Each batch is centred by its own mean before multiplying; means and scatters then combine."""
    width, k = len(model.sums), min(k, len(model.values))
    held = df.select(vector)

    def run(batches):
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = model.project(whole(batch, vector, width)[2].reshape(-1, width), k)
            if len(y):
                n, mean, m = combined(n, mean, m, len(y), y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0)))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], mean, m.ravel()]).tobytes()], pa.binary())], names=["raw"])

    def merge(batches):
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for raw in batch.column("raw"):
                x = np.frombuffer(raw.as_py(), "<f8")
                n, mean, m = combined(n, mean, m, x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], mean, m.ravel()]).tobytes()], pa.binary())], names=["raw"])

    n, mean, m = 0, np.zeros(k), np.zeros((k, k))
    for r in lean(held).mapInArrow(run, "raw binary").repartition(MERGERS).mapInArrow(merge, "raw binary").collect():
        x = np.frombuffer(bytes(r[0]), "<f8")
        n, mean, m = combined(n, mean, m, x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k))
    return float(np.abs(m / n - np.eye(k)).max()) if n and k else 0.0


def combined(n1, mean1, m1, n2, mean2, m2):
    """Count, mean and centred scatter of two disjoint sets together."""
    n = n1 + n2
    if not n:
        return n1, mean1, m1
    d = mean2 - mean1
    return n, mean1 + d * (n2 / n), m1 + m2 + np.outer(d, d) * (n1 * n2 / n)


def whiten(df: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each valid vector and component up to k: key, component (from 1), n, deviation (decimal: sum over dimensions of (n x - S)^2, exact), whitened, explained, identity_error."""
    schema = "key {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(df.schema[key].dataType.simpleString())
    names = [key, *[x.split()[0] for x in schema.split(", ")[1:]]]
    model = fit(df, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], schema).toDF(*names)
    k = min(k, len(model.values))
    error = identity_error(df, model, k, vector)
    width = len(model.sums)

    def run(batches):
        for batch in batches:
            at, _, x = whole(batch, vector, width)
            x = x.reshape(-1, width)
            y = model.project(x, k)
            off = model.n * x - model.sums
            if len(off) and int(np.abs(off).max()) ** 2 * width >= 1 << 63:
                off = off.astype(object)
            dev = np.repeat((off * off).sum(1), k)
            dev = pa.array([Decimal(int(v)) for v in dev], pa.decimal128(38, 0)) if dev.dtype == object else pa.array(dev, pa.int64()).cast(pa.decimal128(38, 0))
            ids = batch.column("key").take(pa.array(np.repeat(at, k)))
            m = len(at) * k
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(m, model.n)), dev,
                    pa.array(y.ravel()), pa.array(np.tile(model.values[:k] / model.trace, len(at))), pa.array(np.full(m, error)),
                ],
                names=["key", *names[1:]],
            )

    out = lean(df.select(F.col(key).alias("key"), vector)).mapInArrow(run, schema)
    return out.toDF(*names)
