"""Embedding whitening by a one-sided Jacobi SVD over blockwise TSQR.

1. Each number c of a vector becomes x = floor(64 c) + 1000000, a long. The fit list holds each distinct x-vector once: n
   vectors with sums S, exact in decimals.
2. Each task centres its rows as (n x - S) / n, whose numerator is exact, and folds them, block after block, into the R of a
   QR factorisation. The tasks' R are folded again in FOLDS tasks, and those on the driver: never more than FOLDS times d
   rows of d numbers.
3. Plane rotations make R's columns orthogonal, d / 2 disjoint pairs at a time, until no pair's cosine is above 1e-15. The
   accumulated rotations are the components; a column's norm over sqrt(n) is the component's standard deviation. Covariances
   are never formed, so small deviations keep their digits.
4. A pass over the fit list sums products of whitened vectors; how far their covariance is from the identity is reported.
   Their mean is zero by construction, as the centred numerators sum to zero exactly.
5. Each row is centred, projected and divided by the deviations.

The dimension is the most frequent length of a vector (the longer of equals). Edge cases: null, empty, or other-length
vectors, and vectors with null or non-finite numbers or with numbers of 2^46 and more, are dropped; a null id stays null.
Repeated rows each get their results and count once in the fit. With fewer distinct vectors than dimensions, or constant
dimensions, components without variance (below 1e-13 of the largest deviation) have null `whitened`, and stay out of identity_error. An empty table has no rows. A
deviation that does not fit a long is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches, written

MOST = 16
#: Tasks of the second folding; rows folded at once.
FOLDS, BLOCK = 64, 4096
#: Numbers whose x, or its products with n, could pass a long's range in numpy go through Python's integers.
_SAFE = 1 << 62


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the rows that take part, x an array of longs of one length."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    v = v.where("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < 70368744177664D)")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("v") == (sizes.d if sizes else 0)).select("id", F.expr("transform(v, c -> floor(64 * c) + 1000000L)").alias("x"))


def _matrix(col: pa.Array) -> np.ndarray:
    """Equal-length lists as rows."""
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact; Python integers where 64 bits could be too few. sums: Python integers."""
    wide = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)
    return x * n - sums.astype(np.int64) if wide < _SAFE else x.astype(object) * n - sums


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n, total) of a task: counts and exact sums by dimension, as text."""
    n, total = 0, None
    for b in batches:
        x = _matrix(b.column(0))
        if len(x):
            own = x.sum(0) if int(np.abs(x).max()) * len(x) < _SAFE else x.astype(object).sum(0)
            n, total = n + len(x), own.astype(object) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(list(map(str, total.tolist())))], names=["place", "n", "total"])


def folded(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """R of the QR factorisation of all rows of the blocks."""
    r = None
    for rows in blocks:
        for k in range(0, len(rows), BLOCK):
            part = rows[k : k + BLOCK]
            r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
    return r


def _rows_of(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["r"])


def _centred_r(n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows_of(folded(_numerators(_matrix(b.column(0)), n, sums).astype(float) / n for b in batches if b.num_rows))

    return run


def _folded_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows_of(folded(_matrix(b.column(0)) for b in batches if b.num_rows))


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each pair of d columns once, in rounds of disjoint pairs: a round-robin tournament."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1], strict=True) if max(a, b) < d]
        out.append((np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(norms, v): v's columns are orthonormal and r @ v has orthogonal columns with these norms, which fall."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)
    for _ in range(sweeps):
        most = 0.0
        for p, q in _rounds(d):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx) * np.sqrt(yy)
            turn = np.abs(xy) > 1e-15 * scale
            if not turn.any():
                continue
            most = max(most, float((np.abs(xy[turn]) / scale[turn]).max()))
            tau = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = c * t
            p, q = p[turn], q[turn]
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
        if most < 1e-14:
            break
    norms = np.linalg.norm(a, axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation: n and sums of the fit list, components (d rows of numbers, one column each) and their standard deviations by falling size."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    #: Sum of all variances, those of components that are not kept included.
    trace: float

    def whitened(self, numerators: np.ndarray) -> np.ndarray:
        """Projections over deviations; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (numerators.astype(float) / self.n) @ self.components / self.deviations
        w[:, ~self.varies] = np.nan
        return w

    @property
    def varies(self) -> np.ndarray:
        return self.deviations > 1e-13 * max(self.deviations.max(initial=0.0), 1e-300)


def fit(x: DataFrame, most: int = MOST) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of x, at most `most` components (None without rows), and the fit list."""
    listed = written(x.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit-list")
    # the fit list's own distribution feeds two small aggregations
    rows = listed.mapInArrow(_sums, "place int, n long, total string").groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38, 0)")).alias("total")).orderBy("place").collect()
    if not rows:
        return None, listed
    n, sums = rows[0].n, np.array([int(r.total) for r in rows], object)
    first = listed.mapInArrow(_centred_r(n, sums), "r array<double>")
    second = first.repartition(FOLDS).mapInArrow(_folded_again, "r array<double>")
    r = folded(iter([np.array([row.r for row in second.collect()])]))
    norms, v = jacobi(r)
    return Whitening(n, sums, v[:, :most], norms[:most] / np.sqrt(n), float((norms**2).sum() / n)), listed


def _products(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                w = model.whitened(_numerators(_matrix(b.column(0)), model.n, model.sums))[:, model.varies]
                total = total + w.T @ w
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    return run


def identity_error(model: Whitening, listed: DataFrame) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = int(model.varies.sum())
    rows = listed.mapInArrow(_products(model), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    cov = np.zeros(k * k)
    for r in rows:
        cov[r.place] = r.total / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0.0))


def _deviation(m: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None beyond a long."""
    if m.dtype != object and float((m.astype(float) ** 2).sum(1).max(initial=0.0)) < 4e18:
        return (m * m).sum(1).tolist()
    return [t if (t := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in m.tolist()]


def _applied(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _numerators(_matrix(b.column(1)), model.n, model.sums)
                w = model.whitened(m)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviation(m), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> tuple[DataFrame, Whitening | None, float]:
    """(id, deviation, whitened array<double>) for each row that takes part, the model, and its identity error."""
    small_batches(vectors.sparkSession)
    x = quantised(vectors, id_col, vector_col)
    model, listed = fit(x, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "id long, deviation long, whitened array<double>"), None, 0.0
    return x.mapInArrow(_applied(model), "id long, deviation long, whitened array<double>"), model, identity_error(model, listed)


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and component."""
    rows, model, error = whitened(vectors, id_col, vector_col, most)
    share = [] if model is None else [float(s) for s in model.deviations**2 / model.trace] if model.trace else [0.0] * len(model.deviations)
    explained = F.array(*map(F.lit, share)) if share else F.expr("cast(array() as array<double>)")
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"),
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
