"""Log files: tagging, multi-line records, routed monthly output."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.chunked import CHUNK, running_sum, with_measures
from .log_files import LogFiles

# fixed values: where each kind of log lives below the archive folder, and how an omlog record starts
PATHS = {
    "auditlog": r"/[^/]*audit\.log$",
    "syslog": r"/log/omm/pg_log/[^/]*\.log$",
    "omlog": r"/log/omm/bin/[^/]*/[^/]*\.log$",
}
ARCHIVE = "archive"
RECORD_START = r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\]"


def tag_of(path: Column, archive: str = ARCHIVE) -> Column:
    tag = F.lit(None).cast("string")
    for name, pattern in PATHS.items():
        tag = F.when(path.rlike(f"/{archive}{pattern}"), name).otherwise(tag)
    return tag


def tag_lines(df: DataFrame, path: str, archive: str = ARCHIVE) -> DataFrame:
    """Stamp tag, cluster and instance address from ``<root>/<cluster>/<ip>/<archive>/…``."""
    p = F.col(path)
    parts = f"/([^/]+)/([^/]+)/{archive}/"
    return df.withColumns({
        "tag": tag_of(p, archive),
        "cluster": F.regexp_extract(p, parts, 1),
        "pod_ip": F.regexp_extract(p, parts, 2),
    }).where("tag IS NOT NULL")


def read_logs(spark: SparkSession, root: str, stream: bool = True, archive: str = ARCHIVE, **options) -> DataFrame:
    """Tagged lines of all log files below ``root``: file, seq (the line's place), ts, text, tag, cluster, pod_ip."""
    spark.dataSource.register(LogFiles)
    reader = (spark.readStream if stream else spark.read).format(LogFiles.name()).options(**options)
    lines = reader.load(root)
    return tag_lines(lines.withColumnRenamed("offset", "seq"), "file", archive)


def record_time(text: Column) -> Column:
    """The time an omlog record starts with, or NULL."""
    return F.regexp_extract(text, RECORD_START, 0).substr(2, 19).try_cast("timestamp")


def assemble_multiline(
    df: DataFrame, key: list[str], seq: str, text: str, is_start: Column, lines_per_chunk: int = 10000
) -> DataFrame:
    """Records of a log: a line that starts none belongs to the record before it.

    Lines are joined inside a chunk first and the pieces of a record, one a chunk, after that, so that a file
    of any size spreads over tasks and a record is whole, however many chunks it runs over.
    """
    order = [F.col(seq)]
    chunk = F.floor(F.col(seq) / lines_per_chunk)
    rows = with_measures(df, key, order, chunk, record=running_sum(F.when(is_start, 1).otherwise(0).cast("bigint")))
    lines = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    parts = rows.withColumn(CHUNK, chunk).groupBy(*key, CHUNK, "record").agg(
        F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"),
        F.count("*").alias("lines"), F.min(seq).alias("first_seq"),
    )
    pieces = F.array_sort(F.collect_list(F.struct(F.col(CHUNK).alias("c"), F.col("text").alias("t"))))
    return parts.groupBy(*key, "record").agg(
        F.min("first_seq").alias("first_seq"), F.sum("lines").alias("lines"),
        F.array_join(F.transform(pieces, lambda x: x["t"]), "\n").alias("text"),
    )


def with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("month", F.date_format(ts, "yyyy.MM"))


def write_logs(df: DataFrame, ts: str, root: str):
    """One directory per tag and month. Every task writes its own files, so a tag that holds most
    of the lines is written by many tasks."""
    out = with_month(df, ts)
    out.write.mode("append").partitionBy("tag", "month").parquet(root)


def month_counts(df: DataFrame, ts: str, size: Column) -> DataFrame:
    return with_month(df, ts).groupBy("tag", "month").agg(
        F.count("*").alias("lines"), F.sum(size).alias("chars")
    )
