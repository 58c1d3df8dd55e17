"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..shipping import ship
from .bitslice_topk import usable
from .common import stage

#: Entries of vectors that are worked on at a time.
BLOCK = 1 << 17
#: Directions beyond the components asked for, power passes before the first look, and at most in all.
OVERSAMPLE, PASSES, MOST = 8, 2, 6
#: Residual of a component against its eigenvalue's distance from its neighbours, up to which it is exact.
EXACT = 1e-12
#: Whole numbers beyond this are set to it: sums of squares of any larger leave every integer type.
LARGEST = 1 << 50
FITS = 1 << 62


@dataclass(frozen=True)
class Center:
    """n vectors with the sums S of each dimension, and S/n as a whole number and a rest."""

    n: int
    sums: tuple[int, ...]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.split()
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None where 64 bits do not hold it."""
        if not len(x):
            return []
        sums = np.array(self.sums, object)
        if self.n * int(np.abs(x).max()) < FITS and max(map(abs, self.sums)) < FITS:
            d = self.n * x - sums.astype(np.int64)
            if (d.astype(np.float64) ** 2).sum(1).max() < FITS:
                return (d * d).sum(1).tolist()
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _blocks(batches: Iterable[pa.RecordBatch], column: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches and their vectors as matrices, of about BLOCK entries."""
    for batch in batches:
        step = max(1, BLOCK // dims)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(rows: DataFrame, dims: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows' blocks of part(x), a matrix of this shape, which the model's size bounds. Each task
    adds its blocks up; Spark adds up the tasks' matrices cell by cell."""

    def run(batches):
        total = None
        for _, x in _blocks(batches, 0, dims):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    found = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[found["cell"].to_numpy(np.int64)] = found["value"].to_numpy(np.float64)
    return out.reshape(shape)


def principal(fit: DataFrame, center: Center, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, components as columns, trace) of the covariance of the vectors in ``fit``, the k largest.

    A random basis of k and some more directions is multiplied by the covariance in passes over all centred
    rows, each pass a sum over tasks of matrices of dimensions by directions. Rayleigh-Ritz on the basis gives the
    components and their residuals. While a residual, against the distance of its eigenvalue from the others, is
    above EXACT, passes go on; where MOST of them cannot suffice, by the rate of the last, the basis is widened to
    the full dimension, where the result is exact. Directions without variance are no components."""
    dims = len(center.sums)
    k = min(k, dims)

    def times(basis: np.ndarray) -> np.ndarray:
        def part(x):
            c = center.centred(x)
            return c.T @ (c @ basis)

        return _summed(fit, dims, basis.shape, part) / center.n

    def trace_of(x):
        return (center.centred(x) ** 2).sum(0, keepdims=True)

    trace = float(_summed(fit, dims, (1, dims), trace_of).sum() / center.n)
    width = min(dims, k + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    before = np.inf
    for passed in range(MOST + 2):
        image = times(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn
        if width == dims:
            break
        residual = np.linalg.norm(image @ turn - ritz * values, axis=0)[:k]
        gap = np.minimum(np.append(np.inf, -np.diff(values))[:k], np.append(-np.diff(values), np.inf)[:k])
        with np.errstate(divide="ignore", invalid="ignore"):
            worst = float(np.nan_to_num(residual / (EXACT * np.maximum(gap, 0.0)), posinf=np.inf).max())
        if passed >= PASSES and worst <= 1:
            break
        # At the rate of the last pass: do the passes that are left suffice?
        if passed < MOST and (passed < PASSES or worst * (worst / before) ** (MOST - passed) <= 1):
            basis, before = np.linalg.qr(image)[0], worst
        else:
            width = dims
            more = np.random.default_rng(seed + 1).standard_normal((dims, dims - basis.shape[1]))
            basis = np.linalg.qr(np.hstack([ritz, more]))[0]
    seen = values[:k] > max(trace, 0.0) * dims * np.finfo(float).eps
    return values[:k][seen], ritz[:, :k][:, seen], trace


def whole_numbers(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of each entry as long, held within LARGEST."""
    bounded = lambda c: F.greatest(F.least(F.floor(c.cast("double") * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: bounded(c) + F.lit(shift).cast("long"))


def whiten(
    vectors: DataFrame, components: int = 16, scale: float = 64, shift: int = 0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become whole numbers floor(scale * c) + shift, floor of the product as a double. The model is fitted on
    the n different ones of these vectors: their sums, and the unit eigenvectors of their covariance by
    falling eigenvalue e. ``whitened`` is the centred vector's coordinate over sqrt(e), ``explained`` is e over the
    trace, ``deviation`` the exact sum of (n*x - S)^2, null where 64 bits do not hold it. ``identity_error`` is
    the largest entry of the whitened fit vectors' covariance minus the identity.

    Vectors that are null or hold a null or non-finite entry take no part, nor those of another length than most
    have (of equally frequent lengths the longest), for they lie in another space; vectors without entries have
    no component. Components without variance are left out: one single vector, or an empty table, gives no
    rows. Rows that repeat an id or vector get rows of their own; a null id stays null. Entries whose whole number is
    beyond 2^50 count as that. Only the two columns named are read.

    The distinct vectors are written once; every pass reads them and gives a matrix of dimensions by
    directions. The driver holds such matrices alone.
    """
    ship(vectors.sparkSession)
    v = F.col(vector_col)
    rows = vectors.filter(usable(v) & (F.size(v) > 0)).select(F.col(id_col).alias("id"), whole_numbers(v, scale, shift).alias("x"))
    rows = stage(rows, "whole-numbers")
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    kind = rows.schema["id"].dataType
    names = (("component", IntegerType()), ("n", LongType()), ("deviation", LongType()), ("whitened", DoubleType()), ("explained", DoubleType()), ("identity_error", DoubleType()))
    schema = StructType([StructField("id", kind), *(StructField(n, t) for n, t in names)])
    if common is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims = common["dims"]
    rows = rows.filter(F.size("x") == dims)
    fit = stage(rows.select("x").distinct(), "fit-list")

    def sums(batches):
        total, n = np.zeros(dims, object), 0
        for _, x in _blocks(batches, 0, dims):
            total, n = total + x.sum(0, dtype=np.int64 if len(x) < 4096 else object), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims)), pa.array([str(t) for t in total]), pa.array([n] * dims)], ["d", "s", "n"])

    added = fit.mapInArrow(sums, "d long, s string, n long").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    found = sorted(added.collect())
    center = Center(found[0]["n"], tuple(int(r["s"]) for r in found))
    values, axes, trace = principal(fit, center, components)
    turn = axes / np.sqrt(values)
    k = len(values)

    def square(x):
        w = center.centred(x) @ turn
        return w.T @ w

    error = float(np.abs(_summed(fit, dims, (k, k), square) / center.n - np.eye(k)).max()) if k else 0.0

    def run(batches):
        for batch, x in _blocks(batches, 1, dims):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, center.n))]
            columns += [pa.array(center.deviations(x), pa.int64()).take(each), pa.array((center.centred(x) @ turn).ravel())]
            columns += [pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    if not k:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
