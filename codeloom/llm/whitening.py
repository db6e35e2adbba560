"""Whitening of embeddings by tall-skinny QR (TSQR): no covariance matrix is formed to find the components.

Entries become whole numbers x, so that n and the sums S of each dimension are exact, and so is n * x - S.  Every task
centres its rows with them and reduces them, block by block, to one triangular factor R; factors are then stacked and
reduced again, ``fan`` at a time, in rounds of Spark tasks until one is left.  Its right singular vectors are the unit
eigenvectors of the covariance, its singular values squared and divided by n the eigenvalues.  A task holds one block of
rows and a few matrices of D x D; the driver gets the last R only.

The error of the whitening is measured on the whitened rows themselves: tasks centre what they hold before multiplying,
and their means and products are combined pairwise, exactly as for one table.

Results for odd input: rows take no part whose vector is null, holds null or non-finite entries, or is shorter than the
longest one; empty vectors have no components; null and repeated ids are rows like all others; where the vectors span
fewer than ``components`` dimensions (a single row, equal rows), the components without variance have whitened and
explained of 0 and count as exact in ``identity_error``; a deviation beyond 64 bits fails; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._common import saved, ship

BLOCK = 4096
_FACTOR = "part long, r binary"


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """id and x (array of long), of the rows that take part."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    e = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("e")).filter(F.col("e").isNotNull() & finite)
    return rows.select("id", F.transform("e", lambda x: F.floor(x * scale).cast("long") + shift).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _stacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _factors(rows: DataFrame, sums: np.ndarray, n: int) -> DataFrame:
    """One factor R for each partition that has rows."""
    dims = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("x").slice(a, BLOCK), dims)
                r = _triangle(np.vstack([r, (n * x - sums) / n]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return rows.select("x").mapInArrow(run, _FACTOR)


def merged_factor(factors: DataFrame, dims: int, fan: int = 16) -> np.ndarray:
    """The R of all rows, from the factors of parts of them: a tree of ``fan`` branches, a level a round."""

    def merge(table: pa.Table) -> pa.Table:
        r = _triangle(_stacked(table.column("r").combine_chunks(), dims))
        return pa.table({"part": [table.column("part")[0].as_py() // fan], "r": pa.array([r.tobytes()], pa.binary())})

    factors = saved(factors, "factors")
    while factors.count() > 1:
        factors = saved(factors.groupBy((F.col("part") / fan).cast("long").alias("g")).applyInArrow(merge, _FACTOR), "factors")
    return np.frombuffer(factors.first()["r"]).reshape(-1, dims)


def components_of(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors as columns, eigenvalues in falling order (0 where there is no variance), and the trace."""
    _, s, vt = np.linalg.svd(r)
    s = np.pad(s, (0, r.shape[1] - len(s)))
    s = np.where(s > s.max(initial=0.0) * max(r.shape) * np.finfo(float).eps, s, 0.0)
    return vt[:most].T, (s * s / n)[:most], float((s * s).sum() / n)


def _projected(x: np.ndarray, sums: np.ndarray, n: int, axes: np.ndarray, e: np.ndarray) -> np.ndarray:
    return ((n * x - sums) / n) @ axes * np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)


def _together(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of two parts together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def identity_error(rows: DataFrame, sums: np.ndarray, n: int, axes: np.ndarray, e: np.ndarray, fan: int = 16) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    dims, k = axes.shape
    schema = "part long, m long, mean binary, products binary"

    def row(part: int, a: tuple[int, np.ndarray, np.ndarray]) -> dict:
        return {"part": pa.array([part]), "m": pa.array([a[0]]), "mean": pa.array([a[1].tobytes()], pa.binary()), "products": pa.array([a[2].tobytes()], pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                z = _projected(_matrix(batch.column("x").slice(a, BLOCK), dims), sums, n, axes, e)
                mean = z.mean(axis=0)
                whole = _together(whole, (len(z), mean, (z - mean).T @ (z - mean)))
        if whole[0]:
            yield pa.RecordBatch.from_pydict(row(TaskContext.get().partitionId(), whole))

    def read(m: int, mean: bytes, products: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        return m, np.frombuffer(mean), np.frombuffer(products).reshape(k, k)

    def merge(table: pa.Table) -> pa.Table:
        whole = (0, np.zeros(k), np.zeros((k, k)))
        for m, mean, products in zip(*(table.column(c).to_pylist() for c in ("m", "mean", "products"))):
            whole = _together(whole, read(m, mean, products))
        return pa.table(row(table.column("part")[0].as_py() // fan, whole))

    parts = saved(rows.select("x").mapInArrow(run, schema), "products")
    while parts.count() > 1:
        parts = saved(parts.groupBy((F.col("part") / fan).cast("long").alias("g")).applyInArrow(merge, schema), "products")
    found = parts.first()
    m, _, products = read(found["m"], found["mean"], found["products"])
    return float(np.abs(products / m - np.diag((e > 0).astype(float))).max())


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and component."""
    spark = vectors.sparkSession
    ship(spark)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = saved(whole_numbers(vectors, id_col, vector_col, scale, shift), "vectors")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("x") == dims)
    per_dimension = rows.agg(F.count(F.lit(1)), *(F.sum(F.col("x")[d]) for d in range(dims))).first()
    n, sums = per_dimension[0], np.array(per_dimension[1:], np.int64)

    r = merged_factor(_factors(rows, sums, n), dims)
    axes, e, trace = components_of(r, n, min(components, dims))
    error = identity_error(rows, sums, n, axes, e)
    share = e / trace if trace else np.zeros(len(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column("x"), dims)
                off = n * x - sums
                if (np.abs(off.astype(float)) ** 2).sum(axis=1).max(initial=0.0) > 9e18:
                    raise OverflowError("a deviation does not fit in 64 bits")
                z = _projected(x, sums, n, axes, e)
                m = len(x)
                each = [np.repeat(np.asarray((off * off).sum(axis=1)), k), z.ravel(), np.tile(share, m)]
                names = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("id").take(names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), *map(pa.array, each), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in out.split(", ")])

    return rows.select("id", "x").mapInArrow(run, out)
