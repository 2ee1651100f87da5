"""Level-triggered switches and deadlines over histories (batch forms of the stream operators)."""

from pyspark.sql import Column, DataFrame, functions as F

from .chunked import CHUNK, ByCount, islands, lag, with_measures, with_previous
from .history import micros, state_intervals

STORAGE_THRESHOLD = 95


def storage_guard(
    df: DataFrame, key: list[str], order: list[str], usage: Column, chunk: Column | None,
    threshold: float = STORAGE_THRESHOLD,
) -> DataFrame:
    """Read-only switch: one row whenever it changes. It starts off."""
    ordered = [F.col(c) for c in order]
    rows = df.select(*key, *order, (usage >= threshold).alias("on"))
    seen = with_measures(rows, key, ordered, chunk, _prev=lag(F.col("on"), ordered))
    return seen.where(F.col("on") != F.coalesce("_prev", F.lit(False))).select(
        *key, *order, F.when(F.col("on"), "ON").otherwise("OFF").alias("switch")
    )


def sync_signal(synced: Column, expected: Column) -> Column:
    return (
        F.when((expected > 0) & (synced == expected), "reached")
        .when(synced < expected, "short")
        .when(expected == 0, "lone")
        .otherwise("over")
    )


def availability_switch(
    df: DataFrame, key: list[str], order: list[str], synced: Column, expected: Column, timeout_s: int,
    chunk: Column | ByCount | None, as_of: Column | None = None,
) -> DataFrame:
    """Availability mode: one row whenever it changes. It starts off.

    Enough synchronous replicas switch it off at once; too few for ``timeout_s`` switch it on
    at the end of that time; a cluster that expects none has it on; more than expected changes
    nothing. Works on the islands of equal signals, of which there are far fewer than polls. An open
    island lasts up to ``as_of``, by default the last poll of all keys.
    """
    ts = order[0]
    rows = df.select(*key, *order, sync_signal(synced, expected).alias("_signal"))
    ended = islands(rows, key, order, F.col("_signal"), chunk, with_chunk=True).withColumnsRenamed({"value": "signal", "next_at": "_end"})
    now = rows.agg(F.max(ts)).scalar() if as_of is None else as_of
    deadline = F.col(ts) + F.expr(f"INTERVAL '{int(timeout_s)}' SECOND")
    timed = ended.withColumn("_due", deadline)
    held = F.when(F.col("_end").isNull(), F.col("_due") <= now).otherwise(F.col("_due") < F.col("_end"))
    wish = (
        F.when(F.col("signal") == "reached", False)
        .when(F.col("signal") == "lone", True)
        .when((F.col("signal") == "short") & held, True)
    )
    # a deadline lies before the next island, so wishes are in the order of their islands
    wishes = timed.select(
        *key, *order, CHUNK, F.when(F.col("signal") == "short", F.col("_due")).otherwise(F.col(ts)).alias("switched_at"), wish.alias("on")
    ).where("on IS NOT NULL")
    seen = with_previous(wishes, key, order, "on")
    return seen.where(F.col("on") != F.coalesce("_prev", F.lit(False))).select(
        *key, "switched_at", F.when(F.col("on"), "ON").otherwise("OFF").alias("switch")
    )


def stuck_states(
    df: DataFrame, key: list[str], order: list[str], state: Column, waiting: list[str], deadline_s: int,
    chunk: Column | ByCount | None, as_of: Column | None = None,
) -> DataFrame:
    """Stays in a waiting state that outlast the deadline; open ones are measured up to ``as_of``, by default the last poll of all keys."""
    spans = state_intervals(df, key, order, state, chunk).where(F.col("value").isin(waiting))
    now = df.agg(F.max(order[0])).scalar() if as_of is None else as_of
    end = F.coalesce("valid_to", now)
    return spans.where(micros(F.col("valid_from"), end) > deadline_s * 1000000).select(
        *key, F.col("value").alias("state"), "valid_from",
        (F.col("valid_from") + F.expr(f"INTERVAL '{int(deadline_s)}' SECOND")).alias("timeout_at"),
        F.col("valid_to").isNull().alias("still_open"),
    )


def poll_coverage(df: DataFrame, key: list[str], ts: str, period_s: int) -> DataFrame:
    """Polls, periods with a poll and periods without one between the first and last poll of a key.

    Missing periods are counted from the ends, so the empty ones are never generated.
    """
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (period_s * 1000000))
    per_slot = df.groupBy(*key, slot.alias("slot")).count()
    return per_slot.groupBy(*key).agg(
        F.sum("count").alias("polls"), F.count("*").alias("covered"),
        (F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("missed"),
    )


def missed_gaps(df: DataFrame, key: list[str], ts: str, period_s: int, chunk_slots: int) -> DataFrame:
    """Runs of periods without a poll: the slot after which they start, and how many."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (period_s * 1000000))
    slots = df.select(*key, slot.alias("slot")).distinct()
    order = [F.col("slot")]
    seen = with_measures(slots, key, order, F.floor(F.col("slot") / chunk_slots), _prev=lag(F.col("slot"), order))
    return seen.where(F.col("slot") - F.col("_prev") > 1).select(
        *key, F.col("_prev").alias("after_slot"), (F.col("slot") - F.col("_prev") - 1).alias("missed")
    )
