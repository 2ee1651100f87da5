"""Grouped extremes without sorting."""

from pyspark.sql import Column, DataFrame, functions as F

_INERT = "_inert"


def group_hashed(df: DataFrame, key: list[Column | str], *aggregates: Column) -> DataFrame:
    """``groupBy(key).agg(aggregates)`` in hash maps, also for extremes of structs.

    Spark sorts for an aggregate whose running value has no fixed width, such as ``max_by`` of a struct, unless one of its
    group is of the object kind, which it keeps in a hash map and sorts only beyond
    ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` keys a task. A list of nothing makes it one; asking that it be
    empty keeps it in the plan.
    """
    return df.groupBy(*key).agg(*aggregates, F.collect_list(F.lit(None).cast("int")).alias(_INERT)).where(F.size(_INERT) == 0).drop(_INERT)
