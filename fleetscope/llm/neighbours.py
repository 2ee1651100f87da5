"""Approximate nearest neighbours by cross-polytope hashing.

A hash is a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) and the
signed axis nearest to the rotated unit vector. Each of several tables keeps all vectors under their
hash; a query probes the buckets of its nearest axes in every table, and its candidates are ranked by
exact inner products of the original vectors.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width, step = *x.shape, 1
    while step < width:
        x = x.reshape(rows, -1, 2, step)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


class CrossPolytope:
    """``tables`` x ``functions`` rotations; a bucket is the code of a table's functions, ``2 * width`` axes each."""

    def __init__(self, dims: int, tables: int, functions: int, seed: int):
        self.dims, self.tables, self.functions = dims, tables, functions
        self.width = 1 << max(1, (dims - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, functions, 3, self.width))

    def axes(self, unit: np.ndarray, table: int, function: int) -> np.ndarray:
        """Nearness of each row to the 2 * width signed axes."""
        x = np.zeros((len(unit), self.width))
        x[:, : self.dims] = unit
        for sign in self.signs[table, function]:
            x = hadamard(x * sign)
        return np.concatenate((x, -x), axis=1)

    def buckets(self, unit: np.ndarray, table: int, probes: int) -> np.ndarray:
        """[row, probe]: the buckets of a table, nearest first: the sums of axis gaps over its functions, smallest first."""
        cost, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
        for f in range(self.functions):
            near = self.axes(unit, table, f)
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            gap = near.max(axis=1, keepdims=True) - np.take_along_axis(near, best, 1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(unit), -1)
            code = (code[:, :, None] * (2 * self.width) + best[:, None, :]).reshape(len(unit), -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, keep, 1), np.take_along_axis(code, keep, 1)
        return code


def _valid(batch, dims: int):
    """(ids, vectors in double precision) of the rows that take part."""
    ids, rows = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
        if i is None or not v.is_valid or len(v) != dims or v.values.null_count:
            continue
        x = np.asarray(v.values, np.float64)
        if np.isfinite(x).all() and x.any():
            ids.append(i)
            rows.append(x)
    return np.array(ids, np.int64), np.array(rows, np.float64).reshape(-1, dims)


def _hashed(rows: DataFrame, polytope: CrossPolytope, probes: int) -> DataFrame:
    """(tbl, bucket, id, v) for every valid vector, table and probe; v: the original vector's doubles as bytes."""

    def run(batches):
        for batch in batches:
            ids, x = _valid(batch, polytope.dims)
            if not len(ids):
                continue
            scale = np.abs(x).max(axis=1, keepdims=True)
            unit = x / scale
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            raw = [r.tobytes() for r in x]
            for table in range(polytope.tables):
                codes = polytope.buckets(unit, table, probes)
                n = codes.shape[1] if len(ids) else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids) * n, table, np.int32)), pa.array(codes.ravel()[: len(ids) * n], pa.int64()), pa.array(np.repeat(ids, n), pa.int64()),
                        pa.array([r for r in raw for _ in range(n)], pa.binary()),
                    ],
                    ["tbl", "bucket", "id", "v"],
                )

    return rows.mapInArrow(run, "tbl int, bucket long, id long, v binary")


def ranked(ids: np.ndarray, x: np.ndarray, query: np.ndarray, query_id: int, near: np.ndarray, k: int):
    """The k best (id, score) for one query among the rows of a block; ``near``: approximate scores that pick the ones to score exactly."""
    other = np.flatnonzero(ids != query_id)
    if len(other) > k:
        line = np.partition(near[other], len(other) - k)[len(other) - k]
        other = other[near[other] >= line - 1e-9 * (1 + abs(line))]
    # one sum from the first component to the last, so that equal vectors have equal scores everywhere
    score = np.cumsum(x[other] * query, axis=1)[:, -1] if len(other) else np.empty(0)
    best = np.lexsort((ids[other], -score))[:k]
    return ids[other][best], score[best]


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 6, probes: int = 24, functions: int = 1, seed: int = 7, block: int = 4096,
    vec: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, ties go to the smaller id. All rows but those of the
    query's own id are candidates; fewer than ``k`` found are all returned. Vectors that are null, zero, of
    another length than most (``common.vectors``), or hold null or non-finite components take no part, nor do rows without
    an id. Rows repeated under one id count once, with the best score. An empty table gives no rows. Other columns
    are not read.

    All rows are indexed. A bucket is cut by a hash of the id into blocks of about ``block`` rows, and its
    queries likewise, so that a bucket of any size is many bounded tasks; a task returns ``k`` rows a query.
    The number of buckets is (2 * width) ** functions; with more vectors take more functions, and more
    tables and probes for the recall asked.
    """
    common.small_batches(vectors.sparkSession)
    rows, dims, _ = common.vectors(vectors, vec, embedding)
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    polytope = CrossPolytope(dims, tables, functions, seed)
    index = common.written(_hashed(rows, polytope, 1), "polytope")
    queries = _hashed(rows.where(F.col("id") % every == 0), polytope, probes)
    sizes = index.groupBy("tbl", "bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"))
    # a bucket's queries come from its neighbours too: about ``probes`` times its own
    cuts = common.written(sizes.select("tbl", "bucket", F.expr(f"cast(ceil(n / {block}) as int)").alias("cuts"), F.expr(f"cast(ceil((q + 1) * {probes} / {block}) as int)").alias("qcuts")), "cuts")
    on = ["tbl", "bucket"]
    held = index.join(cuts, on).select(*on, F.expr("cast(pmod(xxhash64(id), cuts) as int)").alias("part"), F.explode(F.expr("sequence(0, qcuts - 1)")).alias("qpart"), "id", "v")
    asked = queries.join(cuts, on).select(*on, F.explode(F.expr("sequence(0, cuts - 1)")).alias("part"), F.expr("cast(pmod(xxhash64(id, 1), qcuts) as int)").alias("qpart"), "id", "v")
    key = [*on, "part", "qpart"]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = left["id"].to_numpy()
            x = np.frombuffer(b"".join(left["v"]), np.float64).reshape(-1, dims)
            asks, q = right["id"].to_numpy(), np.frombuffer(b"".join(right["v"]), np.float64).reshape(-1, dims)
            for at in range(0, len(asks), 256):
                near = q[at : at + 256] @ x.T
                for own, vector, row in zip(asks[at : at + 256], q[at : at + 256], near):
                    found, score = ranked(ids, x, vector, own, row, k)
                    out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(best, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return search(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = None
