"""Exact top-k inner products: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to shards near each other. A shard's tree is one row of a written table; a node is a range of
the shard's rows with a centre and a radius, and bounds the inner products of a query with its rows. A query is
searched in its own shard first. The k-th score it finds there goes with it to all other shards, where a node, the
root included, is opened only while its bound reaches the current k-th score.
"""

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

_LONG = (-(1 << 63), (1 << 63) - 1)


class BallTree:
    """Rows in node order, nodes as (first row, end row, left child or -1; the right one follows it), and their balls."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: np.ndarray, centre: np.ndarray, radius: np.ndarray):
        self.ids, self.rows, self.nodes, self.centre, self.radius = ids, rows, nodes, centre, radius
        self.length = np.linalg.norm(centre, axis=1)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int) -> "BallTree":
        """Cut in halves along the line between two far rows, until a node has ``leaf`` rows or only equal ones."""
        order, nodes, centre, radius = np.arange(len(ids)), [[0, len(ids), -1]], [], []
        at = 0
        while at < len(nodes):
            low, high, _ = nodes[at]
            own = rows[order[low:high]]
            middle = own.mean(axis=0)
            away = np.sqrt(((own - middle) ** 2).sum(axis=1))
            centre.append(middle)
            radius.append(away.max())
            if high - low > leaf and (own != own[0]).any():
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                cut = (high - low) // 2
                order[low:high] = order[low:high][np.argsort(own @ (other - one), kind="stable")]
                nodes[at][2] = len(nodes)
                nodes += [[low, low + cut, -1], [low + cut, high, -1]]
            at += 1
        return cls(ids[order], rows[order], np.array(nodes, np.int32), np.array(centre), np.array(radius))

    def to_columns(self) -> list[bytes]:
        return [a.tobytes() for a in (self.ids, self.rows, self.nodes, np.column_stack((self.centre, self.radius)))]

    @classmethod
    def from_columns(cls, ids: bytes, rows: bytes, nodes: bytes, balls: bytes, dims: int) -> "BallTree":
        balls = np.frombuffer(balls, np.float64).reshape(-1, dims + 1)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(rows, np.float64).reshape(-1, dims), np.frombuffer(nodes, np.int32).reshape(-1, 3), balls[:, :dims], balls[:, dims])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int):
        """For each query (ids, scores): what can be among its k best, given that k rows elsewhere reach its floor."""
        size = np.linalg.norm(queries, axis=1)[:, None]
        # rounding may not close a node that ties with the k-th score
        bounds = queries @ self.centre.T + size * self.radius + 1e-9 * (1 + size * (self.length + self.radius))
        exact = len(self.rows) == 0 or np.abs(self.rows).max() * max(np.abs(queries).max(initial=0), 1) * self.rows.shape[1] < 1 << 53
        for q, own, floor, bound in zip(queries, query_ids.tolist(), floors.tolist(), bounds.tolist()):
            yield self._one(q, own, floor, bound, k, exact)

    def _one(self, q, own, floor, bound, k, exact):
        ids, scores, kth = np.empty(0, np.int64), np.empty(0, np.int64), floor
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:
            low, high, child = self.nodes[heapq.heappop(heap)[1]]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            score = (self.rows[low:high] @ q).astype(np.int64) if exact else long_products(self.rows[low:high], q)
            near = np.flatnonzero((score >= kth) & (self.ids[low:high] != own))
            if len(near):
                ids, scores = best(np.concatenate((ids, self.ids[low:high][near])), np.concatenate((scores, score[near])), k)
                if len(ids) == k:
                    kth = max(kth, int(scores[-1]))
        return ids, scores


def long_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers too large for doubles, held at the ends of long."""
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, q)), _LONG[0]), _LONG[1]) for r in rows], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of different ids, greatest score first, then smaller id; of one id's scores the greatest."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def top_k(
    vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, shard: int = 8192, leaf: int = 64, block: int = 1024, most_cells: int = 256,
    vec: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of greatest integer inner product for every id divisible by ``every``.

    Components count as floor(``scale`` * component). Candidates are all rows but those of the query's own id; ties go
    to the smaller id; fewer candidates than ``k`` are all returned. Vectors as in ``common.vectors``; rows without an id
    take no part. Rows repeated under one id count once, with the best score. Scores beyond long are held at its ends.
    An empty table, or one row, gives no rows. Other columns are not read.

    Cells lie around at most ``most_cells`` rows drawn by a hash of their ids; the draw decides only what lies together.
    A cell of any size, equal vectors included, is cut by a hash of row numbers into shards of about ``shard`` rows, and
    queries into blocks of about ``block``, so that Python holds one tree and one block at a time. Each
    block meets each shard once, by a product of the two written tables without a shuffle or broadcast; the root's
    bound turns away queries that cannot gain there.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    taken, dims, n = common.vectors(vectors.where(F.col(vec).isNotNull()), vec, embedding)
    if not n:
        return empty
    cells = min(most_cells, -(-n // shard))
    # written first, so that each task's own draw goes to another task, not to the driver
    drawn = common.written(taken.orderBy(F.xxhash64("id"), "id").limit(cells), "drawn").collect()
    pivots = np.floor(scale * np.array([r.e for r in drawn]))
    half = (pivots**2).sum(axis=1) / 2

    def place(batches):
        row = 0
        for batch in batches:
            y = np.floor(scale * common.matrix(batch.column(1), dims))
            near = (y @ pivots.T - half).argmax(axis=1) if len(y) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near, pa.int32()), pa.array(np.arange(row, row + len(y))), batch.column(0), pa.array([r.tobytes() for r in y], pa.binary())], ["cell", "row", "id", "y"]
            )
            row += len(y)

    placed = common.written(taken.mapInArrow(place, "cell int, row long, id long, y binary"), "placed")
    # (cell, first shard, shards) of at most ``most_cells`` cells
    sizes, base = [], 0
    for cell, count in sorted((r.cell, r["count"]) for r in placed.groupBy("cell").count().collect()):
        sizes.append((cell, base, -(-count // shard)))
        base += -(-count // shard)
    cut = spark.createDataFrame(sizes, "cell int, base int, cuts int")
    held = placed.join(F.broadcast(cut), "cell").select(
        F.expr("cast(base + pmod(xxhash64(id, row), cuts) as int)").alias("shard"), "row", "id", "y")

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = np.frombuffer(b"".join(rows["y"]), np.float64).reshape(-1, dims)
        tree = BallTree.build(rows["id"].to_numpy(np.int64), y, leaf)
        return pd.DataFrame([[key[0], *tree.to_columns()]], columns=["shard", "ids", "rows", "nodes", "balls"])

    trees = common.written(held.groupBy("shard").applyInPandas(grow, "shard int, ids binary, rows binary, nodes binary, balls binary"), "trees")
    asked = common.written(held.where(F.col("id") % every == 0), "queries")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        floors = rows["floor"].to_numpy(np.int64)
        return pd.DataFrame(
            [[key[0], rows["id"].to_numpy(np.int64).tobytes(), b"".join(rows["y"]), floors.tobytes(), rows["home"].to_numpy(np.int64).tobytes()]],
            columns=["part", "qids", "qs", "floors", "homes"],
        )

    packed = "part int, qids binary, qs binary, floors binary, homes binary"

    def look(first: bool):
        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ids, homes = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["homes"], np.int64)
                    # a query's own shard was searched first
                    use = np.flatnonzero((homes == r["shard"]) == first)
                    tree = BallTree.from_columns(r["ids"], r["rows"], r["nodes"], r["balls"], dims)
                    qs, floors = np.frombuffer(r["qs"], np.float64).reshape(-1, dims)[use], np.frombuffer(r["floors"], np.int64)[use]
                    out = [(own, *got) for own, got in zip(ids[use], tree.search(qs, ids[use], floors, k)) if len(got[0])]
                    if out:
                        count = [len(i) for _, i, _ in out]
                        kth = [int(s[-1]) if len(s) == k else None for _, _, s in out]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat([o for o, _, _ in out], count), pa.int64()), pa.array(np.concatenate([i for _, i, _ in out])),
                                pa.array(np.concatenate([s for _, _, s in out])), pa.array(kth, pa.int64()).take(pa.array(np.repeat(np.arange(len(out)), count))),
                            ],
                            ["query_id", "vec_id", "score", "kth"],
                        )

        return run

    found_type = "query_id long, vec_id long, score long, kth long"
    at_home = asked.select(F.col("shard").alias("part"), "id", "y", F.col("shard").alias("home"), F.lit(_LONG[0]).alias("floor"))
    at_home = at_home.groupBy("part").applyInPandas(pack, packed).withColumnRenamed("part", "shard")
    # "merge": equal vectors pack so well that a table's size says little of what would be broadcast
    near = common.written(at_home.join(trees.hint("merge"), "shard").mapInArrow(look(True), found_type), "near")

    floors = near.groupBy(F.col("query_id").alias("id")).agg(F.max("kth").alias("floor"))
    parts = max(1, -(-asked.count() // block))
    blocks = asked.join(floors, "id", "left").select(
        F.expr(f"cast(pmod(xxhash64(id, row), {parts}) as int)").alias("part"), "id", "y", F.col("shard").alias("home"), F.coalesce("floor", F.lit(_LONG[0])).alias("floor")
    ).groupBy("part").applyInPandas(pack, packed)
    # tasks read a part of each table; no tree or block goes over the driver or is shuffled once for each that it meets
    far = trees.crossJoin(common.written(blocks, "blocks").hint("shuffle_replicate_nl")).mapInArrow(look(False), found_type)
    once = near.unionByName(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS y
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), common_length AS (
  SELECT len(y) AS dims FROM good GROUP BY 1 ORDER BY count(*) DESC, dims DESC LIMIT 1
), v AS (SELECT vec_id, y FROM good WHERE len(y) = (SELECT dims FROM common_length)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(CAST(q.y AS DOUBLE[]), CAST(c.y AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
