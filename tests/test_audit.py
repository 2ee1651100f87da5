"""Audit minutes are written exactly once, over restarts and repeated batches."""

import shutil

from pyspark.sql import functions as F

from fleetscope.sources.audit import audit_stream, minute_batches, start_audit_batches


def test_minutes_are_neither_lost_nor_repeated(spark, tmp_path):
    feed, out, cp = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = spark.range(600).select(F.col("id"), (F.timestamp_seconds(F.lit(1704067200) + F.col("id"))).alias("at"))

    def add(name, low, high):
        # every poll reads the last seconds of the one before again
        rows.where(F.col("id").between(low, high)).coalesce(1).write.parquet(f"{feed}/{name}")

    def go():
        df = spark.readStream.schema("id bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{feed}/*")
        q = start_audit_batches(audit_stream(df, "at", "id"), out, cp, {"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None

    add("p0", 0, 200)
    add("p1", 180, 330)
    go()
    before = spark.read.parquet(out).count()
    # the last batch was written but its commit is lost: it runs again
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        if p.exists():
            p.rename(tmp_path / f"lost-{p.name}")
    shutil.copytree(out, str(tmp_path / "copy"))
    go()
    assert spark.read.parquet(out).count() == before
    add("p2", 310, 599)
    spark.createDataFrame([(10**6, "2024-01-02 00:00:00")], "id bigint, at string").selectExpr("id", "timestamp(at) AS at").coalesce(1).write.parquet(f"{feed}/p3")
    go()
    cols = ["period_start", "audit_rows", "first_id", "last_id"]
    want = minute_batches(rows, "at", "id").withColumn("period_start", F.col("period_start").cast("timestamp"))
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
