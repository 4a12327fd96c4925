"""Whitening of integer vectors from an exact scatter matrix.

Every entry c becomes the integer floor(256 c). The fit list holds each distinct integer vector once. A task subtracts one
shift vector from its rows, splits the differences into limbs of 16 bits, multiplies limb matrices in doubles (sums of
65,536 products of 32 bits stay below 2**53, so they are exact), and puts the products together as integers of any length.
Spark adds the tasks' sums limb by limb in longs. The driver gets one table of dimensions x dimensions sums, whatever the
number of rows, forms n X'X - SS' exactly (the shift cancels), divides once, and decomposes the result by eigh.

A last pass projects every row; a pass over the fit list measures how far the whitened covariance is from the identity.
Only the fit list is shuffled (distinct vectors of each task); a vector that fills a third of the table is one row a task.

Defined results: rows whose vector is null, or holds null, NaN or an infinite entry, are left out; so are vectors of another
length than that of most remaining rows (ties: the longer), and empty ones. Entries beyond 64 bits are taken as the nearest long.
`deviation` is null where the exact value does not fit a long; `deviation_text` always has its digits. Components whose eigenvalue is
zero to double precision have null `whitened`. Equal eigenvalues leave the choice of their vectors open. Null and
repeated ids are rows like others, repeated vectors count once in the fit. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import _base

#: Integers a unit, and components returned.
SCALE = 256
COMPONENTS = 4
#: Bits of a limb, and rows whose limb products are added in doubles at once.
LIMB = 16
BLOCK = 1 << 16
#: Longs that are added and multiplied without overflow.
SAFE = 1 << 62
#: Bits of the pieces in which tasks hand in their sums.
PIECE = 32

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


@dataclass
class Fit:
    """n, shift, sums and products of the shifted fit list (integers of any length), then eigenvalues and vectors."""

    n: int
    shift: list[int]
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


# ---------------------------------------------------------------- inside a task

def _matrix(col, dims: int) -> np.ndarray:
    """Rows of a list column without nulls."""
    flat = pa.concat_arrays([c.flatten() for c in col.chunks]) if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift: longs, or Python integers where they may not fit."""
    top = SAFE // 2
    if len(x) and (max(map(abs, shift)) >= top or x.max() >= top or x.min() <= -top):
        return x.astype(object) - np.array(shift, dtype=object)
    return x - np.array(shift, dtype=np.int64)


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """Doubles L_k with d = sum of L_k 2**(16 k), as many as the largest entry needs."""
    sign, left, out = np.where(d < 0, -1, 1), np.abs(d), []
    while not out or (left != 0).any():
        out.append(((left & ((1 << LIMB) - 1)) * sign).astype(np.float64))
        left = left >> LIMB
    return out


def scatter(x: np.ndarray, shift: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of x - shift, as Python integers."""
    dims = x.shape[1]
    sums, products = np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
    for lo in range(0, len(x), BLOCK):
        parts = limbs(shifted(x[lo: lo + BLOCK], shift))
        whole = lambda a: a.astype(np.int64).astype(object)
        for k, a in enumerate(parts):
            sums += whole(a.sum(axis=0)) << (LIMB * k)
            products += whole(a.T @ a) << (2 * LIMB * k)
            for m in range(k):
                cross = a.T @ parts[m]
                products += whole(cross + cross.T) << (LIMB * (k + m))
    return sums, products


def pieces(value: int) -> list[tuple[int, int]]:
    """(k, piece) with value = sum of piece 2**(32 k); pieces have the value's sign."""
    sign, left, out, k = (-1 if value < 0 else 1), abs(int(value)), [], 0
    while left:
        if left & ((1 << PIECE) - 1):
            out.append((k, sign * (left & ((1 << PIECE) - 1))))
        left >>= PIECE
        k += 1
    return out


def square_sums(q: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row."""
    if q.dtype != object and q.size:
        top = int(np.abs(q).max())
        if top * top * q.shape[1] < SAFE:
            return (q * q).sum(axis=1).tolist()
        if top < SAFE:  # three limbs of 21 bits: six sums a row, each below 2**63 for up to a million dimensions
            a, b, c = q >> 42, (q >> 21) & 0x1FFFFF, q & 0x1FFFFF
            each = [(x * y).sum(axis=1).tolist() for x, y in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
            return [(aa << 84) + (ab << 64) + (ac << 43) + (bb << 42) + (bc << 22) + cc for aa, ab, ac, bb, bc, cc in zip(*each, strict=True)]
    return [sum(int(v) ** 2 for v in row) for row in q]


def deviations(d: np.ndarray, fit: Fit) -> np.ndarray:
    """n x - S of shifted rows, exact."""
    if d.dtype != object and d.size and int(np.abs(d).max()) * fit.n < SAFE // 2 and max(map(abs, fit.sums)) < SAFE // 2:
        return d * fit.n - np.array(fit.sums, dtype=np.int64)
    return d.astype(object) * fit.n - np.array(fit.sums, dtype=object)


def project(q: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened components of rows n x - S; those of no variance are NaN."""
    good = significant(fit)
    out = np.full((len(q), len(good)), np.nan)
    centred = (q / fit.n).astype(np.float64)
    out[:, good] = centred @ fit.vectors[:, : len(good)][:, good] / np.sqrt(fit.values[: len(good)][good])
    return out


def significant(fit: Fit) -> np.ndarray:
    """Which of the first components have an eigenvalue beyond rounding."""
    first = fit.values[:COMPONENTS]
    return first > max(float(fit.values[0]), 0.0) * len(fit.values) * np.finfo(float).eps


# ---------------------------------------------------------------- over tables

def integers(embedding: Column) -> Column:
    """Vector of longs; null for vectors that are null or hold null or non-finite entries."""
    entry = lambda c: c.cast("double")
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf")))
    # doubles at or beyond 2**63 stop at the limits of a long
    whole = lambda c: F.when(entry(c) * SCALE >= 2.0**63, F.lit(2**63 - 1)).when(entry(c) * SCALE < -(2.0**63), F.lit(-(2**63))).otherwise(F.floor(entry(c) * SCALE))
    return F.when(~bad, F.transform(embedding, whole))


def _sums(rows: DataFrame, column: str, dims: int, make) -> dict[tuple[int, int], int]:
    """Sums over all rows of make(x) -> (sums, products): at most (dims + 1) dims entries come to the driver.

    Row dims of the result holds the sums, rows i < dims the products with j >= i. Tasks hand in pieces of 32 bits; longs add 2**31 of them.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(_matrix(batch.column(0), dims))
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is None:
            return
        out = [(dims, j, k, v) for j in range(dims) for k, v in pieces(total[0][j])]
        out += [(i, j, k, v) for i in range(dims) for j in range(i, dims) for k, v in pieces(total[1][i, j])]
        if out:
            i, j, k, v = (np.array(x, np.int64) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, k, v)], names=["i", "j", "k", "v"])

    found: dict[tuple[int, int], int] = {}
    for r in rows.select(column).mapInArrow(partial, "i long, j long, k long, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.v << (PIECE * r.k))
    return found


def covariance(n: int, sums: list[int], products) -> np.ndarray:
    """(n X'X - SS') / n**2: integers until the one division."""
    dims = len(sums)
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * products(i, j) - sums[i] * sums[j]) / (n * n)
    return v


def fit(distinct: DataFrame, column: str) -> Fit | None:
    """Fit over a written table of distinct vectors of one length."""
    first = distinct.select(column).head(1)
    if not first or not first[0][0]:
        return None
    shift = list(first[0][0])
    dims, n = len(shift), distinct.count()
    found = _sums(distinct, column, dims, lambda x: scatter(x, shift))
    sums = [found.get((dims, j), 0) for j in range(dims)]
    v = covariance(n, sums, lambda i, j: found.get((i, j), 0))
    values, vectors = np.linalg.eigh(v)
    out = Fit(n, shift, sums, values[::-1].copy(), np.ascontiguousarray(vectors[:, ::-1]), float(np.trace(v)))
    out.identity_error = _identity_error(distinct, column, out)
    return out


def _identity_error(distinct: DataFrame, column: str, model: Fit) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity."""
    good = np.flatnonzero(significant(model))
    if not len(good):
        return 0.0
    dims = len(model.shift)

    def products(batches):
        w = np.zeros(len(good))
        ww = np.zeros((len(good), len(good)))
        for batch in batches:
            z = project(deviations(shifted(_matrix(batch.column(0), dims), model.shift), model), model)[:, good]
            w += z.sum(axis=0)
            ww += z.T @ z
        flat = np.r_[w, ww.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    rows = distinct.select(column).mapInArrow(products, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r.v for r in sorted(rows, key=lambda r: r.k)]) / model.n
    mean, second = flat[: len(good)], flat[len(good):].reshape(len(good), len(good))
    return float(np.abs(second - np.outer(mean, mean) - np.eye(len(good))).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text) of all usable vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), integers(F.col(column)).alias("x")).where("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    dims = lengths[0].d
    rows = rows.where(F.size("x") == dims)
    distinct = _base.keep(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, "x")
    _base.forget(distinct)
    first = min(COMPONENTS, dims)
    explained = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values[:first]]

    def one(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = deviations(shifted(_matrix(batch.column(1), dims), model.shift), model)
            z = project(q, model)
            exact = np.repeat(np.array(square_sums(q), dtype=object), first).tolist()
            count = len(q) * first
            flat = z.ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(q)), first)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, first + 1, dtype=np.int32), len(q))), pa.array(np.full(count, model.n)), pa.array([v if v < 2**63 else None for v in exact], pa.int64()),
                pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(q))), pa.array(np.full(count, model.identity_error)), pa.array([str(v) for v in exact], pa.string()),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(one, SCHEMA)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by their own exact scatter."""
    return whiten(_base.table(spark, sf_dir, "embeddings"))
