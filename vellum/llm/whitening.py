"""Embedding whitening: the leading principal components by LOBPCG over distributed covariance products.

The covariance matrix is never built. V B, for a block B of a few vectors, is a sum over rows of (x - mean)(x - mean)'B: each
task multiplies its rows, Spark sums the tasks' results by dimension, and the driver gets one row a dimension. The blocks
are those of LOBPCG: the iterate, its residuals and the previous directions, made orthonormal; V is applied to the whole
basis at once, so the Rayleigh-Ritz step and the residuals come from products and not from sums of rounded ones. It ends
when the residuals of all components are at most CERTIFIED of the largest eigenvalue and stop falling; a run that does not
get there raises an error instead of returning components that are not proved. A residual r bounds the distance of an
eigenvalue by r, and that of its eigenvector by r over the gap to the next one.

A vector's entries become floor(256 * c). The fit list is each distinct vector once, so groups of copies have no weight.

Nulls: vectors that are null, empty, or hold null or non-finite entries (or entries of 2^43 or more, whose numbers doubles
can't hold exactly) take no part, nor do vectors of another length than most rows have (the longer, of equally frequent
ones). A null id stays null. Repeated rows get equal rows each. Components whose eigenvalue is 0 (at most 1e-12 of the
trace) have no whitened form: a table with fewer distinct directions has fewer components, an empty table or one distinct
vector none, so no rows. `deviation` is null where it is beyond 64 bits. Equal eigenvalues leave their components free up to
a rotation; one is chosen for all rows. Only the id and the vector are read, so other columns may have any name.
Vectors may be long; the driver holds some 50 vectors of that length, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import removed, written

CERTIFIED = 1e-11
#: Vectors iterated beside those asked for: eigenvalues close to the last one no longer hold it up.
GUARD = 12


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of the rows that take part, but for their length."""
    v = F.col("v")
    usable = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0))
    usable = usable.where(F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float(1 << 43))))  # false for NaN, which counts as largest
    return usable.select("vec_id", F.transform(v, lambda e: F.floor(F.lit(256.0) * e)).alias("x"))


def matrix(batch: pa.RecordBatch, column: int, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double", held: int = 4096) -> np.ndarray:
    """The sum over all rows x of part(X), a matrix of `width` columns; X is some rows. Tasks add up their rows, Spark the
    tasks; the driver gets the rows of the matrix."""
    names = [f"c{i}" for i in range(width)]
    dtype = {"double": np.float64, "bigint": np.int64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b, 0, d)
            for at in range(0, len(x), held):
                own = part(x[at : at + held])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, i], dtype)) for i in range(width)]], names=["j", *names])

    made = rows.select("x").mapInArrow(run, ", ".join(["j int", *[f"{n} {kind}" for n in names]]))
    got = made.groupBy("j").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    order = np.argsort(got.column("j").to_numpy())
    return np.stack([got.column(n).to_numpy()[order] for n in names], axis=1)


def orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """A basis of what the block adds to others; directions that add nothing but rounding are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # once more against what rounding leaves
        for o in others:
            block = block - o @ (o.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s[0])]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, most: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest residual over the largest eigenvalue) of the k leading pairs."""
    m = min(d, k + GUARD)
    x = orthonormal(np.random.default_rng(0).standard_normal((d, m)))
    basis, last, best = x, np.inf, None
    for _ in range(most):
        image = product(basis)
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1][:m], y[:, ::-1][:, :m]
        x, residual = basis @ y, image @ y - (basis @ y) * e
        if e[0] <= 0:
            return e[:0], x[:, :0], 0.0
        worst = np.linalg.norm(residual[:, :k], axis=0).max() / e[0]
        if best is None or worst < best[2]:
            best = e[:k], x[:, :k], worst
        if last <= CERTIFIED and worst > last / 2:
            break
        last = min(last, worst)
        direction = basis[:, m:] @ y[m:]
        x = orthonormal(x)
        w = orthonormal(residual, x)
        basis = np.concatenate([x, w, orthonormal(direction, x, w)], axis=1)
        m = x.shape[1]
    if best[2] > CERTIFIED:
        raise ArithmeticError(f"no certified components after {most} steps: a residual of {best[2]:.3g} of the largest eigenvalue")
    return best


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that takes part and each of up to k components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    usable = quantised(vectors, id_col, vector_col)
    length = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length:
        return spark.createDataFrame([], schema)
    d = length["d"]
    usable = usable.where(F.size("x") == d)
    fit, folder = written(usable.select("x").distinct(), "vectors")
    sums = summed(fit, d, 2, lambda x: np.stack([x.sum(0), np.full(d, len(x))], axis=1), "bigint")
    total, n = sums[:, 0], int(sums[0, 1])
    mean = total / n
    k = min(k, d)
    width = 3 * min(d, k + GUARD)
    trace = summed(fit, d, 1, lambda x: ((x - mean) ** 2).sum(0)[:, None]).sum() / n

    def product(block: np.ndarray) -> np.ndarray:
        wide = np.zeros((d, width))  # one width, so that Spark compiles one plan
        wide[:, : block.shape[1]] = block

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ wide)

        return summed(fit, d, width, part)[:, : block.shape[1]] / n

    if not trace > 0:
        removed(spark, folder)
        return spark.createDataFrame([], schema)
    e, u, _ = lobpcg(product, d, k)
    some = e > 1e-12 * trace
    e, u = e[some], u[:, some]
    k = len(e)
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(k)])
    to_white, explained = u / np.sqrt(e), e / trace

    def white_sums(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ to_white
        return np.concatenate([y.T @ y, y.sum(0)[:, None]], axis=1)

    white = summed(fit, d, k + 1, white_sums) / n
    error = float(np.abs(white[:, :k] - np.outer(white[:, k], white[:, k]) - np.eye(k)).max())
    removed(spark, folder)
    small = (n * int(np.abs(total).max() // n + 2) * 2) ** 2 * d  # whether 64 bits hold a sum also depends on the row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                x = matrix(own, 1, d)
                if max(small, (n * (int(np.abs(x).max(initial=0)) + int(np.abs(mean).max()) + 1)) ** 2 * d) < 1 << 62:
                    deviation = pa.array(((n * x - total) ** 2).sum(1))
                else:
                    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
                    deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                rows = np.repeat(np.arange(len(x)), k)
                y = (x - mean) @ to_white
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)), deviation.take(pa.array(rows)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.select("vec_id", "x").mapInArrow(run, schema)
