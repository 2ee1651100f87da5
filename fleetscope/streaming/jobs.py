"""Streaming operators. The input is any streaming DataFrame with an event time ``ts`` and a tie breaker ``seq``.

``delay`` is how late rows may come; what they say is applied in order, and reported once the watermark has passed it.
The output of a keyed operator has a column ``late_rows``: null in its own rows, and in a row of its own the number of
rows that came after the delay and were not applied.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.drift import has_mount_reason
from ..operators.switches import STORAGE_THRESHOLD, sync_signal
from .processors import Availability, Builds, Changes, Jobs, Multiline, Polls, Retention, Runs, Stuck

POLL_DELAY = "2 minutes"
#: how long a finished attempt is remembered
ATTEMPT_S = 86400


def _apply(df: DataFrame, key: list[str], processor, output: str, delay: str) -> DataFrame:
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)
    inputs = [F.col(c) for c in processor.inputs]
    # the time goes in as a number, so that rows behind the watermark reach the operator and are counted
    rows = df.withWatermark("ts", delay).select(*key, F.unix_micros("ts").alias("us"), "seq", *inputs)
    return rows.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{types}, {output}, late_rows bigint", outputMode="Append", timeMode="EventTime",
    )


def applied(df: DataFrame) -> DataFrame:
    """The operator's own rows."""
    return df.where("late_rows IS NULL").drop("late_rows")


def change_stream(df: DataFrame, key: list[str], value: Column, initial: str = None, delay: str = POLL_DELAY, keep_s: int = None) -> DataFrame:
    """Rows at which a value changes; conditions, node states and recorded roles all are such values."""
    rows = df.select(*key, "ts", "seq", value.alias("value"))
    return _apply(rows, key, Changes(key, initial, keep_s), "ts timestamp, seq bigint, value string", delay)


def storage_guard_stream(
    df: DataFrame, key: list[str], usage: Column, threshold: float = STORAGE_THRESHOLD, delay: str = POLL_DELAY, keep_s: int = None
) -> DataFrame:
    """Read-only switch of an instance; starts off."""
    return change_stream(df, key, F.when(usage >= threshold, "ON").otherwise("OFF"), "OFF", delay, keep_s)


def failure_stream(df: DataFrame, key: list[str], ok: Column, n: int, delay: str = POLL_DELAY, keep_s: int = None) -> DataFrame:
    rows = df.select(*key, "ts", "seq", ok.alias("ok"))
    return _apply(rows, key, Runs(key, n, False, keep_s), "ts timestamp, seq bigint, outcome string, tries bigint", delay)


def recovery_stream(df: DataFrame, key: list[str], recovered: Column, limit: int, delay: str = POLL_DELAY, keep_s: int = None) -> DataFrame:
    rows = df.select(*key, "ts", "seq", recovered.alias("ok"))
    return _apply(rows, key, Runs(key, limit + 1, True, keep_s), "ts timestamp, seq bigint, outcome string, tries bigint", delay)


def job_stream(df: DataFrame, key: list[str], code: Column, limit: int, delay: str = POLL_DELAY, keep_s: int = ATTEMPT_S) -> DataFrame:
    """Outcome of each attempt. Its state goes once it had no check for ``keep_s``."""
    rows = df.select(*key, "ts", "seq", code.cast("int").alias("code"))
    return _apply(rows, key, Jobs(key, limit, keep_s), "ts timestamp, seq bigint, outcome string, checks bigint", delay)


def build_stream(
    df: DataFrame, key: list[str], code: Column, standby: Column, normal: Column, limit: int, delay: str = POLL_DELAY, keep_s: int = ATTEMPT_S
) -> DataFrame:
    """Outcome of each rebuild, as ``build_outcomes``. Its state goes once it had no check for ``keep_s``."""
    rows = df.select(*key, "ts", "seq", code.cast("int").alias("code"), standby.alias("standby"), normal.alias("normal"))
    return _apply(rows, key, Builds(key, limit, keep_s), "ts timestamp, seq bigint, outcome string, checks bigint", delay)


def stuck_stream(df: DataFrame, key: list[str], state: Column, waiting: list[str], deadline_s: int, delay: str = POLL_DELAY) -> DataFrame:
    rows = df.select(*key, "ts", "seq", state.alias("value"), state.isin(waiting).alias("waiting"))
    return _apply(rows, key, Stuck(key, deadline_s), "value string, valid_from timestamp, timeout_at timestamp", delay)


def availability_stream(
    df: DataFrame, key: list[str], synced: Column, expected: Column, timeout_s: int, delay: str = POLL_DELAY
) -> DataFrame:
    rows = df.select(*key, "ts", "seq", sync_signal(synced, expected).alias("signal"))
    return _apply(rows, key, Availability(key, timeout_s), "switched_at timestamp, switch string", delay)


def multiline_stream(
    df: DataFrame, key: list[str], text: str, is_start: Column, silence_s: int = 30, delay: str = POLL_DELAY,
) -> DataFrame:
    rows = df.select(*key, "ts", "seq", F.col(text).alias("text"), is_start.alias("is_start"))
    return _apply(
        rows, key, Multiline(key, silence_s),
        "record bigint, first_seq bigint, lines bigint, text string", delay,
    )


def poll_gap_stream(df: DataFrame, key: list[str], period_s: int, delay: str = POLL_DELAY) -> DataFrame:
    """Runs of periods without a poll. A gap is told as ``still_open`` once its first period has passed, also for a key that
    falls silent for good, and again with its full length when the next poll comes; the closed ones are those of ``missed_gaps``."""
    return _apply(df.select(*key, "ts", "seq"), key, Polls(key, period_s), "after_slot bigint, missed bigint, still_open boolean", delay)


def retention_stream(df: DataFrame, key: list[str], gzip_days: int = 1, drop_days: int = 3, delay: str = POLL_DELAY) -> DataFrame:
    """What to do with each file and when; ``ts`` is its last change. More than n whole days, as in ``log_retention``."""
    day = 86400 * 1000000
    return _apply(df.select(*key, "ts", "seq"), key, Retention(key, (gzip_days + 1) * day, (drop_days + 1) * day), "action string, due_at timestamp", delay)


def mount_wait_stream(pending: DataFrame, events: DataFrame, key: list[str], min_age_s: int, lookback: str, delay: str = POLL_DELAY) -> DataFrame:
    """``pending`` rows (key, ``ts``, ``age_s``) of members older than ``min_age_s``, with ``exempt``: a mount event of the member
    in the ``lookback`` before. Rows without one are told when the watermarks of both sides have passed.

    Repeated events of a member are dropped within the delay, and either side forgets what no row can need any more.
    """
    waiting = pending.where(F.col("age_s") > min_age_s).withWatermark("ts", delay).alias("p")
    mounts = events.where(has_mount_reason(F.col("reason"))).select(*[F.col(k).alias(f"e_{k}") for k in key], F.col("ts").alias("e_ts"))
    mounts = mounts.withWatermark("e_ts", delay).dropDuplicates([f"e_{k}" for k in key] + ["e_ts"])
    on = F.expr(f"e_ts BETWEEN ts - INTERVAL {lookback} AND ts")
    for k in key:
        on = on & (F.col(f"p.{k}") == F.col(f"e_{k}"))
    return waiting.join(mounts, on, "leftOuter").select(*[F.col(f"p.{k}") for k in key], "ts", "age_s", F.col("e_ts").alias("mount_ts"), F.col("e_ts").isNotNull().alias("exempt"))


def poll_counts(df: DataFrame, key: list[str], period: str, delay: str = POLL_DELAY) -> DataFrame:
    """Polls per key and period, emitted once the period can get no more rows."""
    return df.withWatermark("ts", delay).groupBy(F.window("ts", period), *key).agg(F.count("*").alias("polls")).select(
        *key, F.col("window.start").alias("period_start"), "polls"
    )


def start_log_sink(df: DataFrame, ts: str, root: str, checkpoint: str, trigger: dict):
    """Append tagged lines below one directory per tag and month."""
    out = df.withColumn("month", F.date_format(ts, "yyyy.MM"))
    return (
        out.writeStream.format("parquet").partitionBy("tag", "month").option("path", root)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
