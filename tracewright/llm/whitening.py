"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never built. Spark multiplies it with a few vectors at a time: each task centres its vectors, multiplies them with the block and
adds up, and only sums of (dimensions x block) numbers reach the driver. There, the subspace lives: its Rayleigh-Ritz step gives the
Ritz pairs, those whose residual is as small as double precision allows are locked, largest first, and the subspace grows by
corrections ``t`` with ``(I - QQ')(V - theta)(I - QQ')t = -r``, where ``Q`` holds the locked and the current vectors. MINRES solves these equations roughly, for all
wanted pairs in step, so that one pass over the data serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.storage import stash

#: Entries are taken as so many parts of one.
PARTS = 256
#: Rows of a block of distinct vectors hold about so many numbers.
BLOCK = 1 << 18
#: Partial sums that reach the driver at once, at most; those of more tasks are added up in so many groups first.
FAN_IN = 64
#: Inner MINRES steps for one correction, and dimensions of the subspace at which it is restarted.
INNER, SUBSPACE = 6, 40
#: Outer steps after which the search is given up with an error.
OUTER = 300
#: Residuals count as zero at so many roundings of the largest eigenvalue; so do eigenvalues, which have no component then.
ROUNDINGS = 32


@dataclass
class Fit:
    """The fit list: ``n`` distinct vectors and their sums by dimension."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``: 64-bit integers if all fit, else Python's."""
        if self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` with one rounding, after whole numbers."""
        return (self.deviations(x) / self.n).astype(np.float64)

    def squares(self, x: np.ndarray) -> list[int]:
        """The sum of the squares of ``n x - S`` for each vector, exact."""
        found = self.deviations(x)
        if found.dtype == object or float(np.abs(found).max(initial=0)) ** 2 * found.shape[1] > 2.0**62:
            found = found.astype(object)
        return (found * found).sum(axis=1).tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<long> column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rows, sums`` (by dimension)``, numbers`` (64-bit little-endian, row by row) of a task's distinct vectors."""
    waiting, held = [], 0

    def out() -> pa.RecordBatch:
        x = np.concatenate(waiting)
        # Decimals, as sums of very large numbers go beyond 64 bits.
        sums = pa.array([list(map(Decimal, x.astype(object).sum(axis=0)))], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), sums, pa.array([x.tobytes()], pa.binary())], names=["rows", "sums", "numbers"])

    for batch in batches:
        if batch.num_rows:
            waiting.append(_matrix(batch.column(0)))
            held += waiting[-1].size
        if held >= BLOCK:
            yield out()
            waiting, held = [], 0
    if held:
        yield out()


def over_blocks(blocks: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray], many: bool) -> np.ndarray:
    """The sum of ``of(block)`` (numbers of this shape) over all blocks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for rows, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += of(np.frombuffer(numbers.as_py(), dtype=np.int64).reshape(rows, -1))
        slot = TaskContext.get().partitionId() % FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "part"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py()) for v in table.column("part")], axis=0)
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    found = blocks.mapInArrow(partial, "slot long, part binary")
    if many:
        found = found.groupBy("slot").applyInArrow(added, "slot long, part binary")
    parts = [np.frombuffer(r["part"]) for r in found.collect()]
    return np.sum(parts, axis=0).reshape(shape) if parts else np.zeros(shape)


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``product(t) = right``, column by column in step, after so many steps of MINRES from zero."""
    k = right.shape[1]
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(live, beta, 1)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    phi, b = beta.copy(), np.zeros(k)
    t = np.zeros_like(right)
    for _ in range(steps):
        w = product(v) - b * v_old
        a = (v * w).sum(axis=0)
        w -= a * v
        b_new = np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix, turned by the last two rotations and then by its own.
        epsilon, turned = s_old * b, c_old * b
        delta, gamma_bar = c * turned + s * a, -s * turned + c * a
        gamma = np.hypot(gamma_bar, b_new)
        safe = np.where(gamma > 0, gamma, 1)
        c_old, s_old = c, s
        c, s = np.where(gamma > 0, gamma_bar / safe, 1), np.where(gamma > 0, b_new / safe, 0)
        d_old, d = d, (v - epsilon * d_old - delta * d) / safe
        go = live & (gamma > 0)
        t += np.where(go, c * phi, 0) * d
        phi = -s * phi
        live = go & (b_new > 1e-14 * np.maximum(beta, 1e-300))
        v_old, v, b = v, w / np.where(b_new > 0, b_new, 1), b_new
        if not live.any():
            break
    return t


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to ``against`` and each other; those that add nothing go."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        w = column / size
        for _ in range(3):
            w = w - against @ (against.T @ w)
            for u in kept:
                w = w - u * (u @ w)
            left = np.linalg.norm(w)
            if left < 1e-12:
                break
            w = w / left
        else:
            kept.append(w)
    return np.stack(kept, axis=1) if kept else np.zeros((len(new), 0))


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, and their unit vectors, by Jacobi-Davidson."""
    locked, values = np.zeros((size, 0)), np.zeros(0)
    draw = np.random.default_rng(12)
    basis = _orthonormal(draw.standard_normal((size, min(size, wanted + 2))), locked)
    image = product(basis)
    largest = 0.0
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        largest = max(largest, abs(theta[0]) if len(theta) else 0.0, *np.abs(values))
        ritz, of_ritz = basis @ turn, image @ turn
        # Locked vectors are left out of the residual, as what is sought is orthogonal to them.
        residual = of_ritz - ritz * theta
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        floor = ROUNDINGS * np.finfo(float).eps * largest
        done = 0
        while done < len(theta) and len(values) + done < wanted and sizes[done] <= floor:
            done += 1
        locked, values = np.concatenate([locked, ritz[:, :done]], axis=1), np.concatenate([values, theta[:done]])
        if len(values) == min(wanted, size):
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        todo = min(wanted - len(values), len(theta) - done)
        keep = slice(done, None)
        if basis.shape[1] - done + todo > SUBSPACE:
            keep = slice(done, done + max(todo + 4, SUBSPACE // 3))
        # The basis is turned to the Ritz vectors, so that those locked leave it.
        basis, image, theta, residual = ritz[:, keep], of_ritz[:, keep], theta[keep], residual[:, keep]
        full = np.concatenate([locked, basis[:, :todo]], axis=1)

        def outside(x: np.ndarray, full: np.ndarray = full) -> np.ndarray:
            return x - full @ (full.T @ x)

        def shifted(x: np.ndarray, theta: np.ndarray = theta[:todo], outside: Callable = outside) -> np.ndarray:
            x = outside(x)
            return outside(product(x) - x * theta)

        room = size - locked.shape[1] - basis.shape[1]
        new = minres(shifted, -outside(residual[:, :todo]), INNER) if todo and room else np.zeros((size, 0))
        around = np.concatenate([locked, basis], axis=1)
        new = _orthonormal(new, around)
        if not new.shape[1] and room:  # corrections within rounding: go on with another direction
            new = _orthonormal(draw.standard_normal((size, min(room, max(1, todo)))), around)
        if not new.shape[1]:  # the subspace is the whole space already: what is left is rounding
            basis = np.linalg.qr(basis)[0]
            image = product(basis)
            continue
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise ArithmeticError(f"residuals stay above double precision after {OUTER} steps: {sizes[:wanted]}")


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row with a usable vector and every component.

    A vector's entries count as ``floor(256 * entry)``, and each distinct one counts once in means and covariances, however many rows have it. Rows are left out if their vector is
    null or empty or has null or non-finite entries, or if it has another length than most (of equally frequent lengths, the largest counts). Null and repeated ids
    stay as they are. There are fewer components where vectors have fewer dimensions, or where the covariance has fewer eigenvalues above rounding (none for a single distinct vector): an
    eigenvalue of 0 can't be whitened. Of equal eigenvalues, any orthonormal vectors are taken, the same for all rows. A ``deviation`` beyond long integers is an error.
    """
    spark = rows.sparkSession
    entries = F.transform(F.col("v"), lambda c: F.floor(c.cast("double") * PARTS))
    usable = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter("size(v) > 0").filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    most = usable.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = most["size"] if most else 1
    usable = usable.filter(F.size("v") == size).select("vec_id", entries.alias("x"))
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = stash(usable.select("x").distinct().mapInArrow(_blocks, "rows long, sums array<decimal(38, 0)>, numbers binary"), "vectors")
    n = blocks.agg(F.sum("rows")).first()[0]
    if not n:
        return spark.createDataFrame([], schema)
    sums = blocks.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    fit = Fit(n, [int(r["s"]) for r in sums])
    numbers = blocks.select("rows", "numbers").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        many = numbers.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] >= FAN_IN

        def product(block: np.ndarray) -> np.ndarray:
            def of(x: np.ndarray) -> np.ndarray:
                c = fit.centred(x)
                return c.T @ (c @ block)

            return over_blocks(numbers, block.shape, of, many) / n

        trace = float(over_blocks(numbers, (1,), lambda x: (fit.centred(x) ** 2).sum(keepdims=True)[0], many)[0]) / n
        values, vectors = leading(product, size, min(components, size))
        real = values > ROUNDINGS * np.finfo(float).eps * trace
        values, vectors = values[real], vectors[:, real]
        k = len(values)
        scaled = vectors / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            y = fit.centred(x) @ scaled
            return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

        found = over_blocks(numbers, (k + k * k,), moments, many) / n
    finally:
        numbers.unpersist()
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max(initial=0.0))
    explained = (values / trace).tolist() if k else []

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1))
            m = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([v for v in fit.squares(x) for _ in range(k)], pa.int64()),
                pa.array((fit.centred(x) @ scaled).ravel()), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return usable.mapInArrow(project, schema)
