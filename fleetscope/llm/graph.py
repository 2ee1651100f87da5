"""Connected components by alternating large-star and small-star rounds, as DataFrame operations."""

from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each component, for every node of an edge with two different ends.

    Nodes are longs. Repeated edges, loops and edges with a null end change nothing; no edges give no rows. Each round
    is a pair of aggregations and joins and is written to the shared folder; a node of any degree is
    reduced by partial minima, and its neighbours are joined to one row.
    """
    stars = common.written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        stars = common.written(small.where("u != v").distinct(), "edges")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
