"""Replication reports and log positions printed by the database."""

from pyspark.sql import DataFrame, functions as F

from ..functions.wal import position


def parse_replication(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per sender block: peer ip, percent, state and priority.

    Blocks are cut at ``sender_pid``, so a field missing from one block cannot shift another.
    Only reports of primaries carry senders; filter them before.
    """
    blocks = F.slice(F.split(F.col(text), r"sender_pid\s*:"), 2, F.lit(2**31 - 1).cast("int"))
    rows = df.select(*keep, F.explode(blocks).alias("_b"))
    block = F.col("_b")
    return rows.select(
        *keep,
        F.regexp_extract(block, r"channel\s*:\s[\d.:]*-->([\d.]+)", 1).alias("ip"),
        F.coalesce(F.regexp_extract(block, r"sync_percent\s*:\s(\d+)%", 1).try_cast("int"), F.lit(0)).alias("percent"),
        F.regexp_extract(block, r"sync_state\s*:\s(\w+)", 1).alias("state"),
        F.coalesce(F.regexp_extract(block, r"sync_priority\s*:\s(\d+)", 1).try_cast("int"), F.lit(0)).alias("priority"),
    )


def parse_lsn(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("lsn", position(F.col(text)))
