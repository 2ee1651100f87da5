"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

With the centred rows as matrix X, the method builds X V = U B, B upper bidiagonal, from alternating products
X v and X' u over the rows, and takes principal components and deviations from the small SVD of B. A left vector is as
long as the table, so it is never stored: u = X w for a short w, and tasks make their own part of it from their own
rows, which lets one pass of tasks serve both products of a step. Left vectors are made orthogonal to all earlier
ones twice, first from the products X' u that are known, then from products that tasks add up; right vectors twice as well.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

_SAFE = 1 << 62
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(e: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * e) as longs; what lies beyond them is held at their ends."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * e), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _peak(y: np.ndarray) -> int:
    return max(int(y.max()), -int(y.min())) if y.size else 0


def deviations(y: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * y - total, exactly: longs where they suffice, else Python's integers."""
    if n * _peak(y) + max(map(abs, total)) >= _SAFE:
        return n * y.astype(object) - np.array(total, object)
    return n * y - np.array(total, np.int64)


def centred(y: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return deviations(y, n, total).astype(np.float64) / n


def squares(a: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; null where it is no long."""
    if len(a) and a.dtype != object and a.shape[1] * _peak(a) ** 2 < _SAFE:
        return (a * a).sum(axis=1).tolist()
    sums = (sum(int(v) ** 2 for v in row) for row in a)
    return [s if s < 1 << 63 else None for s in sums]


class Rows:
    """The centred rows as blocks in a written table, and sums over them that tasks add up."""

    def __init__(self, blocks: DataFrame, dims: int, n: int, total: list[int]):
        self.blocks, self.dims, self.n, self.total = blocks, dims, n, total

    def summed(self, of, size: int) -> np.ndarray:
        """Sum of ``of(x)``, ``size`` numbers, over blocks of centred rows."""
        dims, n, total = self.dims, self.n, self.total

        def run(batches):
            held = np.zeros(size)
            for batch in batches:
                for raw in batch.column(0):
                    held += of(centred(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dims), n, total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(held)], ["i", "v"])

        out = np.zeros(size)
        for row in self.blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[row.i] = row.v
        return out

    def back(self, w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """X' u, the square of u, and its products with the left vectors (X w, one w a row of ``left``), for u = X w."""

        def of(x):
            u = x @ w
            return np.concatenate((x.T @ u, [u @ u], (x @ left.T).T @ u))

        got = self.summed(of, self.dims + 1 + len(left))
        return got[: self.dims], float(got[self.dims]), got[self.dims + 1 :]


def bidiagonalise(rows, dims: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(right vectors as rows, B) after ``steps`` steps, ``dims`` at most.

    Where a product leaves nothing new (few independent rows, repeated deviations) the method goes on from a random
    vector orthogonal to all so far; with ``steps = dims`` the basis is whole and no component is missed.
    """
    random = np.random.default_rng(seed)
    right, left, back = np.zeros((0, dims)), np.zeros((0, dims)), np.zeros((0, dims))
    diagonal, above, largest = [], [], 0.0

    def orthogonal(r):
        for _ in range(2):
            r = r - right.T @ (right @ r)
        return r

    def fresh():
        r = orthogonal(random.normal(size=dims))
        return r / np.linalg.norm(r)

    v = fresh()
    for step in range(min(steps, dims)):
        right = np.vstack((right, v))
        # X v without its parts along earlier left vectors, u'(X v) being (X'u)'v
        g, size, again = rows.back(v - left.T @ (back @ v), left)
        w, g, size = v - left.T @ (back @ v + again), g - back.T @ again, size - again @ again
        alpha = np.sqrt(max(size, 0.0))
        largest = max(largest, alpha)
        if alpha <= 1e-13 * largest or not largest:
            alpha, w, g = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, g = w / alpha, g / alpha
        left, back = np.vstack((left, w)), np.vstack((back, g))
        r = orthogonal(g - alpha * v)
        beta = float(np.linalg.norm(r))
        diagonal.append(alpha)
        if step + 1 < min(steps, dims):
            largest = max(largest, beta)
            broken = beta <= 1e-13 * largest or not largest
            v = fresh() if broken else orthogonal(r / beta)
            v /= np.linalg.norm(v)
            above.append(0.0 if broken else beta)
    return right, np.diag(diagonal) + np.diag(above, 1)


def whiten(
    vectors: DataFrame, components: int = 32, scale: int = 64, steps: int | None = None, seed: int = 11, vec: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the whitened row, a row for each component.

    Entries become x = floor(``scale`` * entry) (a constant added to all changes nothing below, so none is). All vectors
    that take part (``common.vectors``) are centred and fitted; components are numbered from 1 by falling deviation,
    at most ``components``. ``deviation`` is the exact sum over dimensions of (n * x - sum)^2, null where that is no
    long. A component whose deviation is not over 1e-10 of the largest is left out: it would be divided by nothing; so
    equal vectors, a single one and an empty table give no rows. Rows without an id and repeated rows stay, each with its
    own output. Other columns are not read.

    ``steps``: by default as many as there are dimensions, one pass over the written rows each; fewer are exact
    only where the leading components have settled by then. The driver holds matrices of dims x dims.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    taken, dims, n = common.vectors(vectors, vec, embedding)
    if not n:
        return spark.createDataFrame([], _OUT)

    def pack(batches):
        for batch in batches:
            y = scaled(common.matrix(batch.column(0), dims), scale)
            if not len(y):
                continue
            sums = y.astype(object).sum(axis=0) if _peak(y) * len(y) >= _SAFE else y.sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([y.tobytes()], pa.binary()), pa.array([[Decimal(int(s)) for s in sums]], pa.list_(pa.decimal128(38, 0)))], ["rows", "sums"]
            )

    blocks = common.written(taken.select("e").mapInArrow(pack, "rows binary, sums array<decimal(38,0)>"), "rows")
    sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = [int(s) for _, s in sorted((r.i, r.s) for r in sums)]
    rows = Rows(blocks.select("rows"), dims, n, total)
    right, small = bidiagonalise(rows, dims, steps or dims, seed)
    _, sigma, turned = np.linalg.svd(small)
    kept = min(components, int((sigma > 1e-10 * sigma[0]).sum())) if sigma[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], _OUT)
    axes, variance = (turned[:kept] @ right).T, sigma[:kept] ** 2 / n
    project = axes / np.sqrt(variance)

    def spread(x):
        z = x @ project
        return np.concatenate(([(x * x).sum()], z.sum(axis=0), (z.T @ z).ravel()))

    sums = rows.summed(spread, 1 + kept + kept * kept)
    trace, mean, square = sums[0] / n, sums[1 : 1 + kept] / n, sums[1 + kept :].reshape(kept, kept) / n
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(kept)).max())
    explained = variance / trace

    def run(batches):
        for batch in batches:
            ids, all_rows = batch.column(0), common.matrix(batch.column(1), dims)
            for at in range(0, len(all_rows), 1024):
                a = deviations(scaled(all_rows[at : at + 1024], scale), n, total)
                m = len(a)
                z = (a.astype(np.float64) / n) @ project
                own = np.repeat(np.arange(m), kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, m).take(pa.array(own)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)),
                        pa.array(squares(a), pa.int64()).take(pa.array(own)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return taken.mapInArrow(run, _OUT)


def query(spark, sf_dir):
    return whiten(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = None
