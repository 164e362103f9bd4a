"""Whitened embeddings from an eigenbasis refined in mixed precision.

Sums and the co-moments about the rounded mean are whole numbers and are added exactly, task by task
and then row by row of the matrix, so the covariance that reaches the driver (its size is the square of
the dimension, whatever the number of vectors) has no error of its own. There the eigenvectors are
worked out in float32 and corrected by Ogita-Aishima iterations, matrix products in extended precision;
eigenvalues that lie closer together than the error are solved again as a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

LIMBS = 5
_LONG = 1 << 63


def whole(vector: Column, factor: float = 256.0) -> Column:
    """Entries as floor(factor * entry), long; null for a vector that is null or holds an entry that
    is null, not finite or too large for a long."""
    unfit = F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(factor)) >= F.lit(float(_LONG)))
    )
    scaled = F.transform(vector, lambda c: F.floor(c * F.lit(factor)).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(unfit, F.lit(False)), scaled)


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column of equally long lists of long as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def to_limbs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as five 32-bit limbs (the last one signed), in rows; sums of limbs stay exact."""
    out = np.empty((*values.shape, LIMBS), np.int64)
    for k in range(LIMBS - 1):
        out[..., k] = values & 0xFFFFFFFF
        values = values >> 32
    out[..., -1] = values
    return out


def from_limbs(limbs: np.ndarray) -> np.ndarray:
    total = np.zeros(limbs.shape[:-1], object)
    for k in range(LIMBS):
        total += limbs[..., k].astype(object) << (32 * k)
    return total


def co_moments(z: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows, exact: in float64 while every partial sum is below 2^53."""
    largest = int(np.abs(z).max(initial=0)) if z.dtype != object else max((abs(v) for v in z.flat), default=0)
    bound = largest * largest * len(z)
    if bound < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if bound < _LONG:
        return z.T @ z
    z = z.astype(object)
    return z.T @ z


def _shifted(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """Rows minus a whole vector; beyond 2^62 in Python numbers."""
    if max(np.abs(x, dtype=float).max(initial=0), max(map(abs, middle), default=0)) < 2.0**61:
        return x - np.array(middle, np.int64)
    return x.astype(object) - np.array(middle, object)


def _totals(dims: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in parts:
            x = matrix_of(batch.column("x"), dims)
            small = np.abs(x, dtype=float).max(initial=0) * max(len(x), 1) < 2.0**62
            n, total = n + len(x), total + x.sum(axis=0, dtype=np.int64 if small else object)
        if n:
            yield _row(-1, np.append(total, n))

    return rows


def _products(dims: int, middle: list[int]):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        met = False
        for batch in parts:
            z = _shifted(matrix_of(batch.column("x"), dims), middle)
            met = met or len(z) > 0
            for at in range(0, len(z), 4096):
                total += co_moments(z[at : at + 4096])
        if met:
            for i in range(dims):
                yield _row(i, total[i])

    return rows


def _row(i: int, values: np.ndarray) -> pa.RecordBatch:
    flat = to_limbs(values).ravel()
    return pa.RecordBatch.from_arrays(
        [pa.array([i], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], ["line", "limbs"]
    )


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Limbs of equal lines added up; a task holds the lines dealt to it, at most the whole matrix."""
    held: dict[int, np.ndarray] = {}
    for batch in parts:
        for line, limbs in zip(batch.column("line").to_pylist(), batch.column("limbs"), strict=True):
            own = limbs.values.to_numpy()
            held[line] = held[line] + own if line in held else own.copy()
    for line, limbs in held.items():
        # carried over, so that the next sum starts from 32-bit limbs again
        yield _row(line, from_limbs(limbs.reshape(-1, LIMBS)))


def _gathered(parts: DataFrame) -> dict[int, np.ndarray]:
    summed = parts.repartition("line").mapInArrow(_added, "line int, limbs array<long>")
    return {r.line: from_limbs(np.array(r.limbs, np.int64).reshape(-1, LIMBS)) for r in summed.collect()}


def eigen(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric extended-precision matrix.

    Starts from float32 eigenvectors. A round measures how far they are from orthonormal and from
    diagonalising the matrix and corrects both to first order, so errors are squared. Vectors whose
    eigenvalues lie within the error of each other are only made orthonormal; their block of the matrix,
    less its mean eigenvalue, is small, and solving it in float64 tells them apart.
    """
    d = len(a)
    largest = float(np.abs(a).max(initial=0))
    if not largest:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    scale = np.longdouble(2.0) ** int(np.ceil(np.log2(largest)))
    a = a / scale
    one = np.eye(d, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm = np.sqrt((a * a).sum())
    noise = 8 * d * np.finfo(np.longdouble).eps * norm  # what rounding leaves in products of the matrix
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # rounding that is not symmetric would be divided by the gaps
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        r, s = r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(np.diag(s))
        close = max(noise, 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        solved = False
        for low, high in _clusters(values, close):
            own = x[:, low:high]
            block = own.T @ (a @ own) - values[low:high].mean() * (own.T @ own)
            rest = np.abs(block - np.diag(np.diag(block))).max()
            if rest > noise:
                turn = np.linalg.eigh((block / np.abs(block).max()).astype(np.float64))[1]
                x[:, low:high], solved = own @ turn.astype(np.longdouble), True
        if not solved and close <= noise:
            break
    for _ in range(2):  # steps between almost equal eigenvalues are as large as rounding over their gap
        x = x + x @ (one - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _clusters(values: np.ndarray, close: float) -> list[tuple[int, int]]:
    """Runs of two or more falling eigenvalues whose neighbours are no further apart than ``close``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > close) + 1
    ends = [0, *cuts.tolist(), len(values)]
    return [(low, high) for low, high in zip(ends[:-1], ends[1:], strict=True) if high - low > 1]


def covariance(n: int, totals: np.ndarray, middle: list[int], products: np.ndarray) -> np.ndarray:
    """Covariance with divisor n from the co-moments about ``middle``, correct to extended precision."""
    rest = [int(t) - n * m for t, m in zip(totals, middle, strict=True)]
    out = np.empty(products.shape, np.longdouble)
    for i in range(len(rest)):
        for j in range(i, len(rest)):
            exact = Fraction(n * int(products[i, j]) - rest[i] * rest[j], n * n)
            high = float(exact)
            out[i, j] = out[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    return out


def _projected(dims: int, middle: list[int], rest: np.ndarray, basis: np.ndarray):
    """Rows centred, then projected on columns that are already divided by the deviation."""

    def values(x: np.ndarray) -> np.ndarray:
        return (_shifted(x, middle).astype(np.float64) - rest) @ basis

    return values


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, factor: float = 256.0
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each usable
    row of the table and each of the first ``components`` components, or all if there are fewer.

    Entries become x = floor(factor * entry). Rows whose vector is null or holds an entry that is null,
    not finite or too large for a long are dropped; so are vectors of another length than the most
    frequent one (of equally frequent ones the longest). Equal vectors count once in the fit; every
    row, with a repeated or null id too, is returned. A component without variance has ``whitened``
    null; if no component has any, ``explained`` and ``identity_error`` are null. ``deviation`` is
    null where it exceeds a long. An empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    out = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    source = rows.select(
        F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col).cast("array<double>"), factor).alias("x")
    ).where(F.col("x").isNotNull())
    usual = source.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if usual is None or not usual.dims:
        return spark.createDataFrame([], out)
    dims = usual.dims
    source = source.where(F.size("x") == dims)
    fit = saved(source.select("x").distinct())
    total = _gathered(fit.mapInArrow(_totals(dims), "line int, limbs array<long>"))[-1]
    n, sums = int(total[-1]), total[:-1]
    middle = [int((2 * t + n) // (2 * n)) for t in sums]
    lines = _gathered(fit.mapInArrow(_products(dims, middle), "line int, limbs array<long>"))
    exact = covariance(n, sums, middle, np.array([lines[i] for i in range(dims)], object))
    values, vectors = eigen(exact)
    trace = np.trace(exact)
    shown = min(components, dims)
    real = int((values[:shown] > trace * dims * 2.0**-52).sum())
    rest = np.array([float(Fraction(int(t) - n * m, n)) for t, m in zip(sums, middle, strict=True)])
    basis = (vectors[:, :real] / np.sqrt(values[:real])).astype(np.float64)
    project = _projected(dims, middle, rest, basis)
    error = _identity_error(fit, dims, project, real)
    share = [float(v / trace) if trace > 0 else None for v in np.maximum(values[:shown], 0)]
    discard(fit)
    return source.mapInArrow(_whitened(dims, n, [int(t) for t in sums], project, real, share, error), out)


def _identity_error(fit: DataFrame, dims: int, project, real: int) -> float | None:
    """Largest entry of the fit list's covariance after whitening less the identity, over the rows."""
    if not real:
        return None

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            w = project(matrix_of(batch.column("x"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], [f"w{k}" for k in range(real)])

    spread = fit.mapInArrow(rows, ", ".join(f"w{k} double" for k in range(real)))
    pairs = [(i, j) for i in range(real) for j in range(i, real)]
    found = spread.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True)))


def _whitened(dims: int, n: int, sums: list[int], project, real: int, share: list, error: float | None):
    shown = len(share)

    def deviations(x: np.ndarray) -> list[int | None] | np.ndarray:
        widest = n * int(np.abs(x, dtype=float).max(initial=0) + 1) + max(map(abs, sums))
        if widest * widest * dims < _LONG:
            far = n * x - np.array(sums, np.int64)
            return np.einsum("nd,nd->n", far, far)
        far = n * x.astype(object) - np.array(sums, object)
        exact = (far * far).sum(axis=1)
        return [int(v) if v < _LONG else None for v in exact]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = matrix_of(batch.column("x"), dims)
            many = len(x)
            each = np.repeat(np.arange(many), shown)
            white = np.zeros((many, shown))
            white[:, :real] = project(x)
            known = np.tile(np.arange(shown) < real, many)
            which = pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(which),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * shown, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(which),
                    pa.array(white.ravel(), mask=~known),
                    pa.array(share * many, pa.float64()),
                    pa.array([error] * (many * shown), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows
