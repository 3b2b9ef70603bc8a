"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the distinct integer vectors is never formed. A pass multiplies it with a
narrow block Q: every task centres its vectors and adds up Xc'(Xc Q), Spark sums these by row. The
recurrence of the Chebyshev polynomials over such passes damps the unwanted part of the spectrum
(Zhou and Saad, 2007); QR and a Rayleigh-Ritz step follow, until the residuals of the wanted
eigenpairs certify them. The driver holds blocks of dimension x (components + guard) numbers only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.shared import staged
from listwright.llm.vectors import integer_vectors


@dataclass(frozen=True)
class Whitening:
    """`guard` more directions than wanted are iterated: the filter damps what lies below them."""

    components: int = 4
    guard: int = 20
    #: Highest degree of one filter, and the most it may raise the first direction above the last.
    degree: int = 8
    growth: float = 1e10
    #: Residual, as a share of the largest eigenvalue, at which an eigenpair is certified, and the
    #: one that must be reached where rounding stops the progress.
    tolerance: float = 1e-13
    least: float = 1e-10
    most_passes: int = 400
    #: Eigenvalues below this share of the trace count as zero: there is nothing to whiten.
    rank: float = 1e-12
    #: Entries become floor(scale * entry).
    scale: int = 256
    #: Vectors kept together in one row of the fit list.
    block: int = 4096


@dataclass(frozen=True)
class Fit:
    """What a fit list says: n vectors with sums S, eigenvalues and components of the covariance."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    components: np.ndarray
    residual: float
    passes: int
    identity_error: float | None


def _blocks(vectors: DataFrame, dimension: int, size: int) -> DataFrame:
    """The vectors as matrices of up to `size` rows, each in the narrowest integer type that holds it."""
    def pack(x: np.ndarray) -> pa.RecordBatch:
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.array_equal(x.astype(k), x))
        return pa.RecordBatch.from_arrays(
            [pa.array([len(x)], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())],
            ["n", "kind", "matrix"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
            count += len(held[-1])
            while count >= size:
                whole = np.concatenate(held)
                yield pack(whole[:size])
                held, count = [whole[size:]], len(whole) - size
        if count:
            yield pack(np.concatenate(held))

    return vectors.select("x").mapInArrow(gather, "n long, kind string, matrix binary")


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, raw in zip(batch.column("kind").to_pylist(), batch.column("matrix"), strict=True):
            yield np.frombuffer(raw.as_buffer(), kind).reshape(-1, dimension)


def _summed(blocks: DataFrame, dimension: int, each: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int],
            kind: str = "double") -> np.ndarray:
    """The sum of each(matrix), all of one shape, over all blocks; Spark adds the tasks' shares row by row."""
    rows, columns = shape
    names = [f"c{j}" for j in range(columns)]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for matrix in _matrices(batches, dimension):
            one = each(matrix)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rows)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(columns)]],
                ["i", *names])

    shares = blocks.mapInArrow(share, ", ".join(["i long", *[f"{c} {kind}" for c in names]]))
    out = np.zeros(shape, np.int64 if kind == "long" else np.float64)
    for row in shares.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():  # `rows` rows
        out[row["i"]] = row[1:]
    return out


def _rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, with their vectors, the vectors' images and the residuals' lengths."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, vq, np.linalg.norm(vq - q * values, axis=0)


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], dimension: int,
                       how: Whitening) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The first eigenvalues and eigenvectors of a symmetric positive matrix given by `times`.

    Also the largest residual as a share of the first eigenvalue and the number of products. Raises
    where the residuals stay above `least`.
    """
    passes = 0

    def image(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    wanted, width = min(how.components, dimension), min(dimension, how.components + how.guard)
    start = np.random.Generator(np.random.PCG64(11)).normal(size=(dimension, width))
    q, _ = np.linalg.qr(start)
    # The first two steps together show where the spectrum ends.
    q, _ = np.linalg.qr(np.hstack([q, image(q)])[:, :dimension])
    values, q, vq, residuals = _rayleigh_ritz(q, image(q))
    floor = max(0.0, values[-1] - residuals[-1])
    values, q, vq, residuals = values[:width], q[:, :width], vq[:, :width], residuals[:width]
    best = np.inf
    while True:
        top = max(values[0], 0.0)
        residual = residuals[:wanted].max() / top if top else 0.0
        if residual <= how.tolerance or (residual <= how.least and residual > best / 2):
            return values[:wanted], q[:, :wanted], float(residual), passes
        if passes >= how.most_passes:
            raise RuntimeError(f"eigenvectors not certified: residual {residual:.1e} after {passes} passes")
        best = min(best, residual)
        # Damp [low, high]: from the end of the spectrum to the last direction of the block.
        high = max(values[-1], top * 1e-12)
        low = min(floor, high * 0.999)
        half, centre = (high - low) / 2, (high + low) / 2
        reach = (top - centre) / half
        degree = int(np.log(how.growth) / np.log(reach + np.sqrt(max(reach * reach - 1, 1e-6))))
        before, now = q, (vq - centre * q) / half
        for _ in range(min(max(degree, 1), how.degree) - 1):
            before, now = now, 2 * (image(now) - centre * now) / half - before
        q, _ = np.linalg.qr(now)
        values, q, vq, residuals = _rayleigh_ritz(q, image(q))


def fit_whitening(vectors: DataFrame, dimension: int, how: Whitening = Whitening()) -> Fit:
    """Fit the components to the distinct vectors `x` (array<long>) of one dimension.

    Copies count once; they meet in a pre-aggregated distinct. Without vectors n is 0 and there are
    no components. Vectors that do not vary in a direction have the eigenvalue 0 there.
    """
    blocks = staged(_blocks(vectors.select("x").distinct(), dimension, how.block))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    if not n or not dimension:
        return Fit(n, np.zeros(dimension, np.int64), 0.0, np.zeros(0), np.zeros((dimension, 0)), 0.0, 0, None)

    def powers(x: np.ndarray) -> np.ndarray:
        wide = x.astype(np.int64)
        return np.stack([wide.sum(axis=0), (wide * wide).sum(axis=0)], axis=1)

    sums, squares = _summed(blocks, dimension, powers, (dimension, 2), "long").T
    trace = (n * sum(map(int, squares)) - sum(int(s) ** 2 for s in sums)) / n**2
    mean = sums / n

    def times(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(blocks, dimension, product, q.shape) / n

    values, components, residual, passes = leading_eigenpairs(times, dimension, how)
    found = values > how.rank * trace
    values = np.where(found, values, 0.0)
    worst = None
    if found.any():
        used, root = components[:, found], np.sqrt(values[found])

        def gram(x: np.ndarray) -> np.ndarray:
            white = ((x - mean) @ used) / root
            return white.T @ white

        count = int(found.sum())
        worst = float(np.abs(_summed(blocks, dimension, gram, (count, count)) / n - np.eye(count)).max())
    return Fit(n, sums, float(trace), values, components, residual, passes, worst)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """sum((n * x - S)^2) per row, exact; null beyond a long."""
    apart = n * x - sums
    close = (apart.astype(np.float64) ** 2).sum(axis=1)
    out = (apart * apart).sum(axis=1).tolist()  # right modulo 2^64, so right wherever it fits
    for row in np.flatnonzero(close > 2.0**62):
        exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[row], sums, strict=True))
        out[row] = exact if exact < 2**63 else None
    return out


def whiten(vectors: DataFrame, fit: Fit) -> DataFrame:
    """One row per vector (vec_id, x) and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    whitened is null for a component without variance, explained where nothing varies, identity_error
    where no component has variance. Rows are made where the vectors lie; nothing is shuffled.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    count, mean = len(fit.values), fit.sums / max(fit.n, 1)
    scaled = fit.components / np.where(fit.values > 0, np.sqrt(fit.values), np.nan)
    explained = [float(v / fit.trace) if fit.trace > 0 else None for v in fit.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not count:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            which = pa.array(np.repeat(np.arange(rows), count))
            white = ((x - mean) @ scaled).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(which), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, fit.n)),
                pa.array(_deviations(x, fit.n, fit.sums), pa.int64()).take(which),
                pa.array(white, mask=np.isnan(white)), pa.array(explained * rows, pa.float64()),
                pa.array([fit.identity_error] * (rows * count), pa.float64()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(
        project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
                 "identity_error double")


def whitened_embeddings(embeddings: DataFrame, how: Whitening = Whitening()) -> DataFrame:
    """`embeddings` (vec_id, embedding) whitened along the first components of its own covariance.

    Vectors that are null, hold null or non-finite entries or have another length than most go. A
    null vec_id stays null; repeated rows count once in the fit and get their rows each. Fewer
    dimensions than components give fewer rows per vector, an empty table none. Other columns are not read.
    """
    vectors, dimension = integer_vectors(embeddings, "embedding", how.scale, "vec_id")
    return whiten(vectors, fit_whitening(vectors, dimension, how))
