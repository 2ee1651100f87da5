"""Audit rows by minute."""

from pyspark.sql import DataFrame, functions as F


def minute_batches(df: DataFrame, ts: str, row_id: str, period: str = "minute") -> DataFrame:
    """Half-open periods, each row in exactly one of them, repeated rows counted once."""
    at = F.date_trunc(period, F.col(ts)).cast("timestamp_ntz")
    unique = df.dropDuplicates([row_id])
    return unique.groupBy(at.alias("period_start")).agg(
        F.count("*").alias("audit_rows"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")
    )


def audit_stream(df: DataFrame, ts: str, row_id: str, lookback: str = "2 minutes", period: str = "1 minute") -> DataFrame:
    """Streaming form: rows that arrive again within the lookback are dropped, a period is told once it can get no more rows."""
    unique = df.withWatermark(ts, lookback).dropDuplicatesWithinWatermark([row_id])
    return unique.groupBy(F.window(ts, period)).agg(
        F.count("*").alias("audit_rows"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")
    ).select(F.col("window.start").alias("period_start"), "audit_rows", "first_id", "last_id")


def start_audit_batches(df: DataFrame, path: str, checkpoint: str, trigger: dict):
    """Writes the periods of ``audit_stream`` so that each is in the table exactly once, whatever fails.

    A batch owns the directory ``batch=<id>`` and writes it anew. After a failure Spark repeats a batch that was not
    committed with the same id and rows, which replaces what the first attempt left.
    """

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
