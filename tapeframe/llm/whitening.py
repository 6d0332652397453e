"""Whitening of embeddings with components found by contour integration (FEAST).

Spark makes the list of distinct whole-number vectors, their sums and their centred products, all exact; a matrix as
wide as a vector is what reaches the driver.  There the spectrum of the covariance V is cut into intervals at gaps.
In each interval the contour integral of (zI - V)^-1 around it, by Gauss-Legendre quadrature of complex shifted solves,
projects random vectors onto the wanted eigenvectors; Rayleigh-Ritz extracts them; and the signs of the pivots of
V - aI (the inertia) at both ends say how many there must be, so that none is missed.  If some are, or if residuals
stay large, the projected space is made larger.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do those with
a scaled component of 2^62 or more.  A whitening is of one vector length: ``width``, or else that of most distinct
vectors (ties: the shorter); other lengths take no part.  Rows without an id and repeated ids keep a result each.
Components without variance (fewer distinct vectors than components, constant positions) are returned with null
``whitened``.  Eigenvectors of equal eigenvalues are any orthonormal set of theirs.  ``deviation`` is null beyond 38
digits.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.llm.exact import floored, matrix, position_sums, usable
from tapeframe.runtime import stage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
PER_INTERVAL, NODES, ROUNDS = 8, 8, 24
LIMB = 20  # bits of a limb: products of two add up exactly in doubles over ROWS rows
ROWS = 4096
FLUSH = 1 << 20
NO_VARIANCE = 1e-13


class Spectrum:
    """Counts of eigenvalues of a symmetric matrix by inertia, on a tridiagonal matrix similar to it."""

    def __init__(self, symmetric: np.ndarray):
        a = np.array(symmetric, dtype=np.float64)
        n = len(a)
        for k in range(n - 2):
            x = a[k + 1:, k].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            length = np.linalg.norm(x)
            if length == 0:
                continue
            v = x / length
            below = a[k + 1:, k + 1:]
            p = below @ v
            w = p - (v @ p) * v
            below -= 2 * (np.outer(v, w) + np.outer(w, v))
            edge = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
            a[k + 1:, k] = a[k, k + 1:] = edge
        self.diagonal, self.beside = np.diag(a).tolist(), np.diag(a, 1).tolist()
        reach = [abs(x) + abs(y) for x, y in zip([0.0, *self.beside], [*self.beside, 0.0])]
        self.low = min(d - r for d, r in zip(self.diagonal, reach))
        self.high = max(d + r for d, r in zip(self.diagonal, reach))
        self.size, self.span = n, max(abs(self.low), abs(self.high), np.finfo(float).tiny)

    def above(self, shift: float) -> int:
        """Number of eigenvalues over ``shift``: positive pivots of the matrix less shift times the identity."""
        tiny = np.finfo(float).eps * self.span * 1e-3
        pivot, positive = 1.0, 0
        for d, e in zip(self.diagonal, [0.0, *self.beside]):
            pivot = d - shift - e * e / pivot
            if abs(pivot) < tiny:
                pivot = -tiny
            positive += pivot > 0
        return positive

    def bracket(self, k: int) -> float:
        """The k-th largest eigenvalue (from 1) by bisection of the counts."""
        low, high = self.low - 1e-3 * self.span, self.high + 1e-3 * self.span
        while high - low > 4e-15 * self.span:
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return (low + high) / 2

    def cut(self, k: int) -> tuple[int, float]:
        """(j, point in the gap after the j-th largest eigenvalue), j >= k: the widest of a few gaps, past any cluster."""
        while k < self.size:
            last = min(k + PER_INTERVAL // 2, self.size - 1)
            values = [self.bracket(j) for j in range(k, last + 2)]
            gaps = [a - b for a, b in zip(values, values[1:])]
            best = int(np.argmax(gaps))
            if gaps[best] > 1e-10 * self.span:
                return k + best, values[best] - gaps[best] / 2
            k = last + 1
        return self.size, self.low - 0.05 * self.span


def project(v: np.ndarray, start: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """Contour integral of (zI - v)^-1 start around [low, high]; the lower half circle mirrors the upper one."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    out, identity = np.zeros_like(start), np.eye(len(v))
    for x, w in zip(points, weights):
        turn = radius * np.exp(0.5j * np.pi * (x + 1))
        out += (0.5 * w * turn * np.linalg.solve((centre + turn) * identity - v, start.astype(complex))).real
    return out


def ritz(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(basis)
    reduced = q.T @ v @ q
    values, vectors = np.linalg.eigh((reduced + reduced.T) / 2)
    return values, q @ vectors


def interval_pairs(v: np.ndarray, low: float, high: float, expected: int, span: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``expected`` eigenpairs inside (low, high)."""
    size, rng = min(len(v), expected + max(4, expected // 2)), np.random.default_rng(seed)
    while True:
        basis = rng.standard_normal((len(v), size))
        for _ in range(ROUNDS):
            values, vectors = ritz(v, basis if size == len(v) else project(v, basis, low, high))
            inside = (values > low) & (values < high)
            off = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == expected and (off <= 1e-14 * len(v) ** 0.5 * span).all():
                return values[inside], vectors[:, inside]
            basis = vectors
        if size == len(v):
            if inside.sum() == expected:
                return values[inside], vectors[:, inside]
            raise ArithmeticError(f"{inside.sum()} eigenvalues found between {low} and {high}, {expected} counted")
        size = min(len(v), 2 * size)


def largest_components(v: np.ndarray, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors as columns; the first largest entry is positive."""
    spectrum = Spectrum(v)
    count = min(count, len(v))
    top, done, found = spectrum.high + 0.05 * spectrum.span, 0, []
    while done < count:
        until, low = spectrum.cut(min(done + PER_INTERVAL, count))
        if spectrum.above(low) - spectrum.above(top) != until - done:
            raise ArithmeticError("counts at the ends of an interval disagree")
        found.append(interval_pairs(v, low, top, until - done, spectrum.span, seed + done)[1])
        top, done = low, until
    values, vectors = ritz(v, np.concatenate(found, axis=1))
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[order], vectors[:, order]
    lead = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) * (1 - 1e-9), axis=0)
    return values, vectors * np.sign(vectors[lead, np.arange(count)])


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """values = sum of limb[s] * 2^(LIMB * s), limbs as doubles that hold whole numbers."""
    out = []
    while True:
        low = values & ((1 << LIMB) - 1)
        if not len(values) or (np.abs(values) < (1 << LIMB)).all():
            return [*out, values.astype(np.float64)]
        out.append(low.astype(np.float64))
        values = values >> LIMB


def product_sums(fit_list: DataFrame, shift: list[int], width: int) -> list[list[int]]:
    """Exact sums of the products of x - shift, as a full matrix of whole numbers."""
    centre = np.array(shift, dtype=np.int64)
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows = 0

        def flushed():
            for power, total in sums.items():
                flat = total[i, j].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), power, dtype=np.int32)), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                                  pa.array(flat)], names=["power", "i", "j", "total"])
            sums.clear()

        for batch in batches:
            values = matrix(batch.column(0), width) - centre
            for at in range(0, len(values), ROWS):
                parts = limbs(values[at:at + ROWS])
                for a, left in enumerate(parts):
                    for b, right in enumerate(parts):
                        sums[a + b] = sums.get(a + b, 0) + (left.T @ right).astype(np.int64)
            rows += len(values)
            if rows >= FLUSH:
                yield from flushed()
                rows = 0
        yield from flushed()

    parts = fit_list.mapInArrow(run, "power int, i int, j int, total bigint")
    out = [[0] * width for _ in range(width)]
    for row in parts.groupBy("power", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toArrow().to_pylist():
        value = int(row["total"]) << (LIMB * row["power"])
        out[row["i"]][row["j"]] += value
        if row["i"] != row["j"]:
            out[row["j"]][row["i"]] += value
    return out


@dataclass(frozen=True)
class Whitening:
    """Everything a task needs to whiten rows; its size depends on the width of a vector alone."""

    n: int
    shift: list[int]  # floor of the mean
    rest: list[int]  # sums less n * shift, each from 0 to n - 1
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def varied(self) -> np.ndarray:
        return self.values > NO_VARIANCE * len(self.shift) * max(self.trace, 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN where there is no variance."""
        centred = (x - np.array(self.shift, dtype=np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])
        root = np.where(self.varied(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return centred @ self.vectors / root

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 of each row, None beyond 38 digits."""
        apart = x - np.array(self.shift, dtype=np.int64)
        largest = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if largest * largest * len(self.shift) >= 1 << 62:
            apart = apart.astype(object)
        off = apart * self.n - np.array(self.rest, dtype=apart.dtype)
        return [v if v < 10 ** 38 else None for v in (off * off).sum(axis=1).tolist()]


def fit(fit_list: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """fit_list: one list<long> column of distinct vectors of that width, at least one."""
    (n,), (sums,) = position_sums(fit_list, lambda values: np.zeros(len(values), dtype=np.int64), 1, width)
    shift = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift)]
    products = product_sums(fit_list, shift, width)
    v = np.array([[(n * p - rest[i] * rest[j]) / (n * n) for j, p in enumerate(row)] for i, row in enumerate(products)])
    trace = float(np.trace(v))
    if trace > 0:
        values, vectors = largest_components(v, components)
    else:
        values, vectors = np.zeros(min(components, width)), np.eye(width)[:, :components]
    return Whitening(n, shift, rest, values, vectors, trace)


def identity_error(fit_list: DataFrame, whitening: Whitening) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity; None if no component has variance."""
    width, varied = len(whitening.shift), whitening.varied()
    if not varied.any():
        return None
    i, j = np.triu_indices(int(varied.sum()) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            white = whitening.project(matrix(batch.column(0), width))[:, varied]
            white = np.concatenate([white, np.ones((len(white), 1))], axis=1)  # the last row holds the sums
            total = total + white.T @ white
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])

    size, full = int(varied.sum()), np.zeros((int(varied.sum()) + 1,) * 2)
    for row in fit_list.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        full[row.i, row.j] = full[row.j, row.i] = row.total / whitening.n
    covariance = full[:size, :size] - np.outer(full[:size, size], full[:size, size])
    return float(np.abs(covariance - np.eye(size)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           width: int | None = None) -> DataFrame:
    """key, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error: up to ``components`` rows for each usable row."""
    key_type = rows.schema[key].dataType.simpleString()
    schema = f"key {key_type}, component int, deviation decimal(38,0), whitened double"
    clean = rows.where(usable(F.col(vector), scale)).select(F.col(key).alias("key"), floored(F.col(vector), scale, offset).alias("x"))
    distinct = stage(clean.select("x").distinct(), "fit_list")
    if width is None:
        lengths = distinct.groupBy(F.size("x").alias("size")).count().where("size > 0")
        width = lengths.agg(F.max(F.struct("count", (-F.col("size")).alias("size")))["size"].alias("size")).first()["size"]
        width = None if width is None else -width
    fit_list = distinct.where(F.size("x") == F.lit(width if width is not None else -2))
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if width is None or fit_list.isEmpty():
        return rows.sparkSession.createDataFrame([], f"{key} {key_type}, component int, n bigint, deviation decimal(38,0), "
                                                     "whitened double, explained double, identity_error double")
    model = fit(fit_list, width, components)
    error = identity_error(fit_list, model)
    count = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1), width)
                take = pa.array(np.repeat(np.arange(len(x)), count))
                white = model.project(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                     pa.array(model.deviation(x), pa.decimal128(38, 0)).take(take), pa.array(white, mask=np.isnan(white))],
                    names=["key", "component", "deviation", "whitened"])

    explained = [float(max(e, 0.0)) / model.trace if model.trace > 0 else None for e in model.values]
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    out = clean.where(F.size("x") == width).mapInArrow(run, schema)
    return out.withColumns({"n": F.lit(model.n).cast("long"), "explained": F.element_at(shares, F.col("component")),
                            "identity_error": F.lit(error).cast("double")}).select(names).withColumnRenamed("key", key)
