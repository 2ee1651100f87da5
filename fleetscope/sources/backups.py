"""Backup records: five lines each, the last one written with ``=``."""

from pyspark.sql import DataFrame, functions as F

STAMP = "yyyyMMddHHmmss"


def parse_backup_records(df: DataFrame, text: str) -> DataFrame:
    def field(name):
        return F.regexp_extract(text, rf"(?m)^{name}[:=](\S*)", 1)

    def stamp(name):
        return F.try_to_timestamp(field(name), F.lit(STAMP)).cast("timestamp_ntz")

    return df.withColumns({
        "start_ts": stamp("start_time"),
        "end_ts": stamp("end_time"),
        "status": field("backup_status"),
        "file": field("backup_file"),
        "size_bytes": field("backup_size").try_cast("bigint"),
    })


def backup_history(records: DataFrame, key: list[str]) -> DataFrame:
    """Runs, failures, bytes and duration percentiles per cluster.

    Percentiles come from counts per whole second, so a cluster with very many backups sends
    at most one row per distinct duration.
    """
    seconds = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))
    per_second = records.groupBy(*key, seconds.alias("s")).agg(
        F.count("*").alias("n"),
        F.count_if(F.expr("status = 'failed'")).alias("failed"),
        F.sum("size_bytes").alias("bytes"),
    )
    return per_second.groupBy(*key).agg(
        F.sum("n").alias("runs"), F.sum("failed").alias("failed"), F.sum("bytes").alias("bytes"),
        F.round(F.sum("failed") / F.sum("n"), 6).alias("failure_rate"),
        F.round(F.percentile("s", F.lit(0.5), F.col("n")), 3).alias("p50_s"),
        F.round(F.percentile("s", F.lit(0.95), F.col("n")), 3).alias("p95_s"),
    )
