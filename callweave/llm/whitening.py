"""Embedding whitening: leading components of the covariance by LOBPCG, every product a job over centred rows.

1. Vectors become whole numbers, ``floor(256 * c)``, kept as bytes. Those that are null or hold null or non-finite entries
   go, as do those of another length than the table's commonest (of equally common ones the greatest). The fit list is each
   distinct vector once: its size n and its exact sums S come from partial sums.
2. LOBPCG on a block of ``BLOCK`` directions. One job an iteration multiplies the covariance with the new residual directions W: each task
   centres its rows, and only d rows of block width leave it, added up by Spark. Rayleigh-Ritz on [X, P, W], iterate, previous
   direction and residual blocks, kept orthonormal in coefficient space, so products of X and P follow without another job.
3. It ends when the residuals of the wanted components, from a fresh product, are at most ``TOLERANCE`` times the greatest
   eigenvalue. If rounding lets them fall no further, the least reached stands; above ``CERTIFIED`` it is an error.
4. Each row is projected on the components and divided by the eigenvalue's root. The whitened fit list's covariance is measured by
   one more job.

The driver holds matrices of d by three blocks, whatever the number of rows. No group is gathered; a very common vector is
merged map-side before the fit list's shuffle.

Components without variance (below 1e-12 of the trace) can't be whitened and are left out, so an empty table or one whose
vectors are all equal gives no rows. Null ids and repeated rows are rows like others. Values beyond 64 bits saturate as a
Spark cast does; a deviation beyond 64 bits is null. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch

COMPONENTS, BLOCK, SEED = 4, 16, 20_240
TOLERANCE, CERTIFIED, ROUNDS, PATIENCE = 1e-13, 1e-8, 300, 6
SCALE = 256
TOP = float(2**63 - 1024)
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double"


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id, d, x``: the vectors that remain, x their whole numbers as little-endian 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            sizes = pc.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
            good = (sizes > 0) & (np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.nan_to_num(np.clip(np.floor(SCALE * flat), -TOP, TOP)).astype("<i8")[good[row]].tobytes()
            ends = np.concatenate(([0], np.cumsum(8 * sizes[good])))
            x = [values[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array(sizes[good], pa.int32()), pa.array(x, pa.binary())], ["vec_id", "d", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, d int, x binary")


def _rows(b: pa.RecordBatch, d: int, at: int = 0) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(at).to_pylist()), "<i8").reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)  # halves of 32 bits: neither overflows below 2^31 rows a task
        for b in batches:
            x = _rows(b, d)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).collect()
    out = [0] * d
    for r in got:
        out[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return (got[0]["n"] if got else 0), out


def _added(fit: DataFrame, d: int, rows: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part``, which makes a matrix (rows by width) of a batch of them; one such matrix leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in batches:
            total += part(_rows(b, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), *(pa.array(total[:, k]) for k in range(width))], ["i", *names])

    names = [f"c{k}" for k in range(width)]
    schema = ", ".join(["i int", *(f"{c} double" for c in names)])
    out = np.zeros((rows, width))
    for r in fit.select("x").mapInArrow(run, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = r[1:]
    return out


def product(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times ``block``, from centred rows."""

    def part(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return c.T @ (c @ block)

    return _added(fit, len(mean), len(mean), block.shape[1], part) / n


def _apart(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what ``block`` has beside ``basis``, without directions shorter than ``least``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, unit vectors and residual norms of the ``wanted`` greatest of a symmetric positive operator of size d."""

    def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = basis.T @ image
        values, c = np.linalg.eigh((small + small.T) / 2)
        return values[::-1], c[:, ::-1]

    def residuals(values: np.ndarray, x: np.ndarray, ax: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = ax - x * values
        return r, np.linalg.norm(r[:, :wanted], axis=0)

    b = min(block, d)
    x = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, b)))[0]
    values, c = ritz(x, ax := multiply(x))
    x, ax = x @ c, ax @ c
    p = ap = np.zeros((d, 0))
    best, since, fresh = np.inf, 0, True
    for _ in range(ROUNDS):
        r, norms = residuals(values, x, ax)
        scale = max(values[0], 0.0)
        if norms.max() <= TOLERANCE * scale or since >= PATIENCE:
            if fresh:
                break
            # recurrences drift: certify by a product of the iterate itself
            values, c = ritz(x, ax := multiply(x))
            x, ax, p, ap, fresh = x @ c, ax @ c, p[:, :0], ap[:, :0], True
            continue
        if norms.max() < best / 2:
            best, since = norms.max(), 0
        else:
            since += 1
        w = _apart(r, np.hstack((x, p)), 1e-3 * TOLERANCE * scale)
        if not w.shape[1]:
            if fresh:
                break
            since = PATIENCE
            continue
        basis, image = np.hstack((x, p, w)), np.hstack((ax, ap, multiply(w)))
        values, c = ritz(basis, image)
        values, top = values[:b], c[:, :b]
        rest = top.copy()
        rest[:b] = 0  # the step beside the old iterate: the next previous direction
        q = _apart(rest, top, 1e-10)
        x, ax, p, ap, fresh = basis @ top, image @ top, basis @ q, image @ q, False
        # Rounding in long products of orthonormal factors stays small, but adds up: renewed here at no cost of a job.
        x, tri = np.linalg.qr(x)
        ax = np.linalg.solve(tri.T, ax.T).T
        signs = np.sign(np.diag(tri))
        x, ax = x * signs, ax * signs
    if not fresh:
        values, c = ritz(x, ax := multiply(x))
        x, ax = x @ c, ax @ c
    _, norms = residuals(values, x, ax)
    if norms.max() > CERTIFIED * max(values[0], 0.0):
        raise ArithmeticError(f"residuals of {norms.max():.3g} against an eigenvalue of {values[0]:.3g}")
    return values[:wanted], x[:, :wanted], norms


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual`` for each remaining row and component."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    every = scratch.save(whole(vectors))
    common = every.groupBy("d").agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], WHITENED)
    d = common["d"]
    rows = every.where(F.col("d") == d)
    fit = scratch.save(rows.select("x").distinct())
    n, totals = sums(fit, d)
    mean = np.array([float(s // n) + (s % n) / n for s in totals])
    trace = float(_added(fit, d, d, 1, lambda x: ((x - mean) ** 2).sum(0)[:, None]).sum()) / n
    if not trace:
        return spark.createDataFrame([], WHITENED)
    values, axes, norms = lobpcg(lambda w: product(fit, mean, n, w), d, min(components, d), max(block, min(components, d)))
    held = int((values > 1e-12 * trace).sum())
    scaled = axes[:, :held] / np.sqrt(values[:held])

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.vstack((y.T @ y, y.sum(0)))

    got = _added(fit, d, held + 1, held, moments) / n
    error = float(np.abs(got[:held] - np.outer(got[held], got[held]) - np.eye(held)).max())
    shares = [float(v) / trace for v in values[:held]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(totals, object)
        small = max(map(abs, totals), default=0) < 2**62
        for b in batches:
            x = _rows(b, d, 1)
            bound = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, totals))
            if small and bound**2 * d < 2.0**62:
                deviation = ((n * x - s.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [v if v < 2**63 else None for v in ((n * x.astype(object) - s) ** 2).sum(1).tolist()]
            y = (x - mean) @ scaled
            for k in range(held):
                same = lambda v, t: pa.array([v] * len(x), t)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), same(k + 1, pa.int32()), same(n, pa.int64()), pa.array(deviation, pa.int64()), pa.array(y[:, k]), same(shares[k], pa.float64()), same(error, pa.float64()), same(float(values[k]), pa.float64()), same(float(norms[k]), pa.float64())],
                    [c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)
