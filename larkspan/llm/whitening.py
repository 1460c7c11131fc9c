"""Whitening of vectors by matrix-free block subspace iteration.

The covariance is never formed. Each Spark pass over the distinct rows X, centred before anything is multiplied, returns Xᵀ(XQ) for a block Q of
orthonormal columns: every task adds up its own rows' part, the parts are added dimension by dimension in the shuffle, and the driver receives
as many rows as there are dimensions. There the next block is made by QR, and Rayleigh-Ritz over the subspaces of the passes so far gives
eigenvalues, vectors and their residuals; new blocks are the directions of the residuals. When the residuals certify all components, a last
pass measures them anew from the rows, together with the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import checkpoint_dir, mapped, materialize, shuffle_partitions

#: Components, columns of a block beyond them, and the residual (of the largest eigenvalue) that certifies one.
COMPONENTS, EXTRA, RESIDUAL = 16, 16, 1e-12
#: Columns of the subspace at most (beyond them it starts again from its best ones), passes at most, and rows that one product takes.
SUBSPACE, PASSES, ROWS = 1024, 200, 8192
#: Entries of absolute value 2**40 and more have no whole number here: the exact sums would not hold them.
LARGEST = float(1 << 40)


@dataclass
class Basis:
    """n fitted rows, their exact sums, eigenvalues (falling) and vectors (columns), the trace, residuals of unit vectors relative to the largest
    eigenvalue, the error of the whitened covariance, and how many passes were made."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    passes: int


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """vec_id and x, of the rows that take part: those of the most frequent length (ties: the shorter)."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    own = own.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fit)
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 0
    return own.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, d)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dimension, count, upper and lower half of the sum) of one task's rows, exact."""
    high = low = None
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.asarray(batch.column(0).flatten(), np.int64).reshape(batch.num_rows, -1)
        if high is None:
            high = low = np.zeros(x.shape[1], np.int64)
        high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x less the mean, whose whole part is taken off exactly."""
    return (x - whole).astype(np.float64) - part


def _product(q: np.ndarray, whole: np.ndarray, part: np.ndarray):
    """Rows (dimension, its row of Xᵀ(XQ), the trace's part) of one task's rows."""
    d, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((d, width)), np.zeros(d)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for lo in range(0, len(x), ROWS):
                c = centred(x[lo : lo + ROWS], whole, part)
                total += c.T @ (c @ q)
                squares += (c * c).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(squares)], ["dim", "y", "square"])

    return run


def _added(width: int):
    """Rows of one dimension come together; they are added as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width)
            for dim, row, square in zip(batch.column(0).to_pylist(), y, batch.column(2).to_pylist()):
                held[dim] = held.get(dim, 0) + np.append(row, square)
        if held:
            rows = list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r[:-1] for r in rows], pa.list_(pa.float64())), pa.array([r[-1] for r in rows])], ["dim", "y", "square"])

    return run


def product(fitted: DataFrame, q: np.ndarray, whole: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: Xᵀ(XQ), and the sum of the squares of X."""
    schema = "dim int, y array<double>, square double"
    parts = fitted.select("x").transform(mapped, _product(q, whole, part), schema)
    rows = parts.repartition(min(len(q), shuffle_partitions(fitted.sparkSession)), "dim").transform(mapped, _added(q.shape[1]), schema).collect()
    out, squares = np.zeros(q.shape), 0.0
    for r in sorted(rows):
        out[r.dim] = r.y
        squares += r.square
    return out, squares


def orthonormal(block: np.ndarray, against: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """By QR, the directions of the block beyond the columns of ``against``; those that are hardly more than rounding are left out."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > least]
    return block


def fit(fitted: DataFrame, k: int = COMPONENTS, extra: int = EXTRA, tolerance: float = RESIDUAL, subspace: int = SUBSPACE, passes: int = PASSES, seed: int = 7) -> Basis | None:
    """The k leading eigenvectors of the covariance of the rows x of ``fitted`` (divisor n), by block subspace iteration. Fewer where the rows have fewer
    dimensions or lower rank. None if there are no rows. If ``passes`` do not certify them, the residuals say how far they are."""
    sums = fitted.select("x").transform(mapped, _exact_sums, "dim int, n long, high long, low long")
    wide = sums.groupBy("dim").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).orderBy("dim").collect()
    if not wide:
        return None
    d, n, total = len(wide), wide[0].n, [(int(r.high) << 32) + int(r.low) for r in wide]
    whole, part = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])
    width = min(d, k + extra)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block, made = orthonormal(np.random.default_rng(seed).standard_normal((d, width)), basis), 0
    while True:
        y, squares = product(fitted, block, whole, part)
        made += 1
        basis, image = np.hstack([basis, block]), np.hstack([image, y / n])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values, kind="stable")
        values, turn = values[best], turn[:, best]
        vectors, moved = basis @ turn[:, :width], image @ turn[:, :width]
        rest = moved - vectors * values[:width]
        scale = max(values[0], np.finfo(float).tiny)
        # The subspace holds all dimensions, or nothing that the rows move lies outside it.
        if made >= passes or basis.shape[1] == d or (np.linalg.norm(rest[:, :k], axis=0) <= tolerance * scale).all():
            break
        if basis.shape[1] + width > max(subspace, 2 * width):
            basis, image = vectors, moved
        block = orthonormal(rest, basis)
        if not block.shape[1]:
            break
    keep = [i for i in range(min(k, vectors.shape[1])) if values[i] > d * np.finfo(float).eps * values[0]] if values[0] > 0 else []
    vectors, _ = np.linalg.qr(vectors[:, keep]) if keep else (vectors[:, :0], None)
    if not keep:
        return Basis(n, total, values[:0], vectors, squares / n, np.zeros(0), 0.0, made)
    # The last pass: values, residuals and the whitened covariance from the rows themselves.
    y, squares = product(fitted, vectors, whole, part)
    y /= n
    values = (vectors * y).sum(0)
    error = (vectors.T @ y) / np.sqrt(np.outer(values, values)) - np.eye(len(values))
    residuals = np.linalg.norm(y - vectors * values, axis=0) / values[0]
    return Basis(n, total, values, vectors, squares / n, residuals, float(np.abs(error).max()), made + 1)


def _whiten(basis: Basis):
    n, total = basis.n, basis.sums
    whole, part = np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])
    rest = np.array([s % n for s in total], np.int64)
    turn = basis.vectors / np.sqrt(basis.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, exact; null beyond a long."""
        y = x - whole
        top = int(np.abs(y).max(initial=0)) * n + n
        if top * top * max(1, x.shape[1]) < 1 << 63:
            return ((y * n - rest) ** 2).sum(1).tolist()
        out = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, rest)) for row in y]
        return [v if v < 1 << 63 else None for v in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(x), pa.int64()), pa.array(list(centred(x, whole, part) @ turn), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"]
            )

    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: float = 64.0, shift: int = 1000000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and component up to k: vec_id, component (from 1, falling eigenvalue), n, deviation, whitened, explained, identity_error, residual.

    Entries c become whole numbers x = floor(scale * c) + shift. Mean, covariance (divisor n) and components are those of the distinct x vectors,
    each counted once; every row is whitened by them. deviation is the exact sum over dimensions of (n * x - S) ** 2, null where that is no long.
    residual is that of the unit eigenvector, relative to the largest eigenvalue, measured in a pass of its own.

    Rows take no part whose vector is null or empty, holds a null, a non-finite entry or one of absolute value 2**40 or more, or has another length
    than the most frequent one (ties: the shorter). A null id stays null; repeated ids and rows are whitened each. Components of eigenvalue 0 do not
    exist: fewer dimensions or a lower rank than k give fewer components, one distinct vector none. Empty table: empty result. Other columns are
    not read.
    """
    own = whole_numbers(vectors, id_col, vector_col, scale, shift)
    checkpoint_dir(vectors.sparkSession)
    fitted = materialize(own.select("x").distinct())
    basis = fit(fitted, k)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if basis is None or not len(basis.values):
        return vectors.sparkSession.createDataFrame([], schema)
    each = own.transform(mapped, _whiten(basis), "vec_id long, deviation long, whitened array<double>")
    placed = each.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    pick = lambda x: F.element_at(F.array(*(F.lit(float(v)) for v in x)), F.col("at") + 1)
    return placed.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(basis.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        pick(basis.values / basis.trace).alias("explained"),
        F.lit(basis.identity_error).alias("identity_error"),
        pick(basis.residuals).alias("residual"),
    )
