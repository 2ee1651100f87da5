"""Every streaming form equals its batch form over the same rows, cut into several micro-batches."""

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.capacity import log_retention
from fleetscope.operators.drift import mount_wait_exemption
from fleetscope.operators.history import build_outcomes, change_points, consecutive_failures, job_outcomes, recovery_outcomes
from fleetscope.operators.switches import availability_switch, missed_gaps, storage_guard, stuck_states
from fleetscope.sources.logs import assemble_multiline
from fleetscope.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"
KEY = ["user_id"]
ORDER = ["ts", "seq"]


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(EVENTS).select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "event_type", "value")
    # a closing row per key, so that no deadline is open at the end
    last = rows.agg(F.max("ts").alias("m")).first()["m"]
    closing = rows.select("user_id").distinct().select(
        "user_id", (F.lit(last) + F.expr("INTERVAL 1 HOUR")).alias("ts"),
        (F.lit(10**9) + F.col("user_id")).alias("seq"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    return rows.union(closing)


SHUFFLED_S = 5400


@pytest.fixture(scope="module", params=["in order", "shuffled"])
def stream(spark, events, tmp_path_factory, request):
    """The rows as files, one per micro-batch: in time order, or each row up to an hour and a half later than its time.

    A last row of a key of its own moves the watermark past all others.
    """
    root = tmp_path_factory.mktemp("feed")
    arrival = F.unix_timestamp("ts")
    if request.param == "shuffled":
        arrival = arrival + F.pmod(F.xxhash64("seq"), F.lit(SHUFFLED_S))
    rows = events.withColumn("arrival", arrival)
    bounds = rows.selectExpr(f"percentile_approx(arrival, array({'0.3, 0.6, 0.8' if request.param == 'shuffled' else '0.5'})) AS b").first()["b"]
    low = -1
    for i, high in enumerate([*bounds, 2**62]):
        part = rows.where((F.col("arrival") > low) & (F.col("arrival") <= high)).drop("arrival").coalesce(1)
        part.write.parquet(str(root / f"part{i}"))
        low = high
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    spark.range(1).select(
        F.lit(-1).cast("bigint").alias("user_id"), (F.lit(last) + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(2**40).alias("seq"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.parquet(str(root / "part9"))

    def open_stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(root / "part*"))

    return open_stream


def run(spark, df, tmp_path):
    out = str(tmp_path / "out")
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None
    got = spark.read.schema(df.schema).parquet(out)
    if "late_rows" in got.columns:
        assert got.where("late_rows IS NOT NULL").isEmpty()
        got = got.where("user_id >= 0") if "user_id" in got.columns else got
    return got


def same(left, right, cols):
    a = sorted(map(tuple, left.select(*cols).collect()))
    b = sorted(map(tuple, right.select(*cols).collect()))
    assert a == b
    assert a


DELAY = "2 hours"


def test_storage_guard(spark, events, stream, tmp_path):
    usage = F.least(F.col("value"), F.lit(100.0))
    got = run(spark, jobs.storage_guard_stream(stream(), KEY, usage, 60, delay=DELAY), tmp_path)
    want = storage_guard(events, KEY, ORDER, usage, F.date_trunc("day", "ts"), 60)
    same(got.withColumnRenamed("value", "switch"), want, ["user_id", "ts", "seq", "switch"])


def test_condition_changes(spark, events, stream, tmp_path):
    got = run(spark, jobs.change_stream(stream(), KEY, F.col("event_type"), delay=DELAY), tmp_path)
    want = change_points(events.drop("value"), KEY, ORDER, F.col("event_type"), F.date_trunc("day", "ts"))
    same(got, want, ["user_id", "ts", "seq", "value"])


def test_failure_run(spark, events, stream, tmp_path):
    ok = ~F.col("event_type").isin("error", "signup", "view")
    got = run(spark, jobs.failure_stream(stream(), KEY, ok, 3, delay=DELAY), tmp_path)
    want = consecutive_failures(events, KEY, ORDER, ok, 3, F.date_trunc("day", "ts"))
    same(got, want, ["user_id", "ts", "seq"])


def test_recovery(spark, events, stream, tmp_path):
    ok = ~F.col("event_type").isin("error", "signup", "view")
    got = run(spark, jobs.recovery_stream(stream(), KEY, ok, 2, delay=DELAY), tmp_path)
    want = recovery_outcomes(events, KEY, ORDER, ok, 2, F.date_trunc("day", "ts"))
    same(got, want, ["user_id", "ts", "seq", "outcome", "tries"])


def test_jobs(spark, events, stream, tmp_path):
    code = F.when(F.col("seq") % 11 == 0, 1).when(F.col("seq") % 2 == 0, 2).otherwise(3)
    got = run(spark, jobs.job_stream(stream(), KEY, code, 10, delay=DELAY), tmp_path)
    rows = events.withColumn("code", code)
    want = job_outcomes(rows, KEY, ORDER, "code", 10, F.date_trunc("day", "ts")).where("outcome <> 'running'")
    same(got, want, ["user_id", "outcome", "checks"])


def test_stuck(spark, events, stream, tmp_path):
    waiting = ["purchase", "signup", "error"]
    got = run(spark, jobs.stuck_stream(stream(), KEY, F.col("event_type"), waiting, 7200, delay=DELAY), tmp_path)
    want = stuck_states(
        events, KEY, ORDER, F.col("event_type"), waiting, 7200, F.date_trunc("day", "ts"))
    same(got.withColumnRenamed("value", "state"), want, ["user_id", "state", "valid_from", "timeout_at"])


def test_availability(spark, events, stream, tmp_path):
    synced, expected = (F.col("seq") % 4).cast("int"), (F.col("user_id") % 3).cast("int")
    got = run(spark, jobs.availability_stream(stream(), KEY, synced, expected, 3600, delay=DELAY), tmp_path)
    want = availability_switch(
        events, KEY, ORDER, synced, expected, 3600, F.date_trunc("day", "ts"))
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    # a key still short at the closing row reaches its deadline only after the data ends
    same(got.where(F.col("switched_at") <= last), want, ["user_id", "switched_at", "switch"])


def test_multiline(spark, events, stream, tmp_path):
    starts = F.col("event_type").isin("click", "error")
    text = F.concat_ws(" ", "event_type", "seq")
    lines = stream().withColumn("text", text)
    got = run(spark, jobs.multiline_stream(lines, KEY, "text", starts, 10**7, delay=DELAY), tmp_path)
    want = assemble_multiline(events.withColumn("text", text), KEY, "seq", "text", starts, 200)
    # the last record of a key has no next start, so in the stream it is still open
    last = want.groupBy(*KEY).agg(F.max("record").alias("record"))
    want = want.join(last, [*KEY, "record"], "left_anti")
    same(got, want, ["user_id", "record", "first_seq", "lines", "text"])


def test_poll_counts_drop_nothing_in_order(spark, events, stream, tmp_path):
    got = run(spark, jobs.poll_counts(stream(), KEY, "1 hour", DELAY), tmp_path)
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    want = events.groupBy(F.window("ts", "1 hour"), *KEY).agg(F.count("*").alias("polls")).select(
        *KEY, F.col("window.start").alias("period_start"), "polls")
    closed = F.col("period_start") < F.lit(last) - F.expr("INTERVAL 1 HOUR")
    same(got.where(closed), want.where(closed), ["user_id", "period_start", "polls"])


def test_builds(spark, events, stream, tmp_path):
    code = F.when(F.col("seq") % 83 == 0, 1).when(F.col("seq") % 4 == 0, 2).when(F.col("seq") % 5 == 0, 3).otherwise(0)
    standby, normal = F.col("seq") % 3 == 0, F.col("seq") % 29 == 0
    got = run(spark, jobs.build_stream(stream(), KEY, code, standby, normal, 6, delay=DELAY, keep_s=10**7), tmp_path)
    rows = events.withColumn("code", code)
    want = build_outcomes(rows, KEY, ORDER, "code", standby, normal, 6, F.date_trunc("day", "ts")).where("outcome <> 'running'")
    same(got, want, ["user_id", "outcome", "checks"])
    assert {r.outcome for r in want.collect()} == {"fail", "success", "success_not_normal"}


def test_poll_gaps(spark, events, stream, tmp_path):
    got = run(spark, jobs.poll_gap_stream(stream(), KEY, 3600, delay=DELAY), tmp_path)
    want = missed_gaps(events, KEY, "ts", 3600, 24)
    same(got.where("NOT still_open"), want, ["user_id", "after_slot", "missed"])
    # the last poll of every key is followed by silence, told without another poll
    ends = events.groupBy("user_id").agg(F.max(F.floor(F.unix_micros("ts") / 3600000000)).alias("after_slot"))
    same(got.where("still_open").join(ends, ["user_id", "after_slot"]), ends, ["user_id", "after_slot"])


def test_retention(spark, events, stream, tmp_path):
    files = stream().select("user_id", "ts", "seq")
    got = run(spark, jobs.retention_stream(files, ["user_id", "seq"], 1, 3, DELAY), tmp_path)
    as_of = F.lit(events.where("event_type <> 'view' OR value <> 1.0").agg(F.max("ts").alias("m")).first()["m"])
    done = got.where(F.col("due_at") <= as_of).groupBy("user_id", "seq").agg(F.count("*").alias("n"), F.max_by("action", "due_at").alias("action"))
    aged = events.withColumns({"age": F.floor((F.unix_micros(as_of) - F.unix_micros("ts")) / 86400000000), "bytes": F.lit(1)})
    want = log_retention(aged, ["user_id"], F.col("age")).where("action <> 'keep'")
    same(done.groupBy("user_id", "action").agg(F.count("*").alias("files")), want, ["user_id", "action", "files"])
    assert {(r.action, r.n) for r in done.collect()} == {("compress", 1), ("drop", 2)}
    assert got.groupBy("user_id", "seq", "action").count().where("count > 1").isEmpty()


def feed(spark, tmp_path, batches, columns="k bigint, ts string, seq bigint, v string"):
    root = tmp_path / f"feed{len(list(tmp_path.iterdir()))}"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, columns)
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(root / f"p{i}"))
    schema = columns.replace("ts string", "ts timestamp")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "p*"))


def collect(df, tmp_path):
    q = df.writeStream.format("memory").queryName("collected").option("checkpointLocation", str(tmp_path / "cp-memory")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table("collected").collect(), q


END = (9, "2024-01-02 00:00:00", 9, "z")


def test_rows_within_the_delay_are_applied_in_order(spark, tmp_path):
    df = feed(spark, tmp_path, [[(1, "2024-01-01 00:00:10", 2, "b")], [(1, "2024-01-01 00:00:05", 1, "a"), (1, "2024-01-01 00:00:20", 3, "b")], [END]])
    rows, _ = collect(jobs.change_stream(df, ["k"], F.col("v"), delay="10 seconds"), tmp_path)
    assert [(r.value, r.seq) for r in rows if r.k == 1] == [("a", 1), ("b", 2)]


def test_rows_after_the_delay_are_counted(spark, tmp_path):
    late = [(1, "2024-01-01 00:00:05", 1, "a"), (1, "2024-01-01 00:00:06", 4, "c"), (1, "2024-01-01 00:02:00", 5, "b")]
    df = feed(spark, tmp_path, [[(1, "2024-01-01 00:01:00", 2, "b")], [(1, "2024-01-01 00:01:30", 3, "b")], late, [END]])
    rows, _ = collect(jobs.change_stream(df, ["k"], F.col("v"), delay="10 seconds"), tmp_path)
    assert [(r.value, r.late_rows) for r in rows if r.k == 1] == [("b", None), (None, 2)]


def test_finished_attempts_are_forgotten(spark, tmp_path):
    """Many short attempts leave no state once each had no check for the time it is kept."""
    day = [[(k, f"2024-01-{d:02d} 00:00:{s:02d}", 100 * d + s, "1") for k in range(10 * d, 10 * d + 5) for s in (1, 2)] for d in range(1, 8)]
    df = feed(spark, tmp_path, [*day, [(999, "2024-02-01 00:00:00", 9, "1")]])
    rows, q = collect(jobs.job_stream(df, ["k"], F.col("v").cast("int"), 3, delay="1 minute", keep_s=3600), tmp_path)
    assert sorted(r.k for r in rows) == [k for d in range(1, 8) for k in range(10 * d, 10 * d + 5)]
    sizes = [p["stateOperators"][0]["customMetrics"].get("numValueStateVars") is not None and p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 60 and sizes[-1] <= 6


def test_mount_waits(spark, tmp_path):
    pending = [(1, "a", "2024-01-01 00:10:00", 400), (1, "b", "2024-01-01 00:10:00", 400), (1, "c", "2024-01-01 00:10:00", 200), (2, "a", "2024-01-01 00:10:00", 500)]
    mounts = [(1, "a", "2024-01-01 00:09:00", "FailedMount"), (1, "a", "2024-01-01 00:09:00", "FailedMount"), (1, "b", "2024-01-01 00:09:00", "Pulled"),
              (1, "c", "2024-01-01 00:09:00", "FailedMount"), (2, "a", "2023-12-31 00:00:00", "FailedAttachVolume")]
    p_cols, e_cols = "k bigint, ip string, ts string, age_s bigint", "k bigint, ip string, ts string, reason string"
    p = feed(spark, tmp_path, [pending, [(9, "z", "2024-01-05 00:00:00", 400)], [(9, "z", "2024-01-06 00:00:00", 400)]], p_cols)
    e = feed(spark, tmp_path, [mounts, [(9, "z", "2024-01-05 00:00:00", "FailedMount")], [(9, "z", "2024-01-06 00:00:00", "FailedMount")]], e_cols)
    rows, _ = collect(jobs.mount_wait_stream(p, e, ["k", "ip"], 300, "1 HOUR", "1 minute"), tmp_path)
    got = sorted((r.k, r.ip, r.exempt) for r in rows if r.k < 9)
    assert got == [(1, "a", True), (1, "b", False), (2, "a", False)]
    # the batch form over the same members says the same
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k bigint, ip string")
    instances = spark.createDataFrame([(k, ip, False, "Pending", age) for k, ip, _, age in pending], "k bigint, ip string, ready boolean, phase string, age_s bigint")
    recent = spark.createDataFrame([m for m in mounts if m[2] > "2024"], e_cols)
    batch = mount_wait_exemption(members, instances, recent, ["k"], 300).first()
    assert batch.exempt == sum(x for k, _, x in got if k == 1)
