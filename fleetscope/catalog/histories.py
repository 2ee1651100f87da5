"""Histories: snapshots, changes, intervals, runs, as-of lookups, ranked rows."""

from pyspark.sql import functions as F

from ..operators.chunked import ByCount, by_minute
from ..operators.capacity import percent
from ..operators.history import (
    change_points, consecutive_failures, fullest_volumes, latest_snapshot, spec_in_force, state_intervals,
    sync_by_priority, transition_matrix,
)
from .common import ORDER, sync
from .registry import query

EVENT_ORDER = ["ts", "event_id"]


@query("latest_snapshot", """
SELECT cluster_id, slot, probe_ts, k1, k2, CAST(k3 AS INT) AS k3, role_tag, connections FROM ox_latest
""")
def _(fx):
    rows = fx("fx_probe").select("cluster_id", "slot", *ORDER, "role_tag", "connections")
    last = latest_snapshot(rows, ["cluster_id", "slot"], ORDER)
    return last.select("cluster_id", "slot", "probe_ts", "k1", "k2", F.col("k3").cast("int").alias("k3"), "role_tag", "connections")


@query("change_points", """
SELECT * FROM (
  SELECT cluster_id, ts, event_id, state, lag(state) OVER (PARTITION BY cluster_id ORDER BY ts, event_id) AS previous FROM fx_state
) s WHERE state IS DISTINCT FROM previous
""")
def _(fx):
    return change_points(fx("fx_state"), ["cluster_id"], EVENT_ORDER, F.col("state"), by_minute("ts")).drop("value")


@query("state_intervals", """
WITH c AS (
  SELECT cluster_id, ts, event_id, state FROM fx_state
  QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY cluster_id ORDER BY ts, event_id)
)
SELECT cluster_id, state, ts AS valid_from, lead(ts) OVER w AS valid_to,
       epoch_us(lead(ts) OVER w) - epoch_us(ts) AS duration_us
FROM c WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, event_id)
""")
def _(fx):
    spans = state_intervals(fx("fx_state"), ["cluster_id"], EVENT_ORDER, F.col("state"), by_minute("ts"))
    return spans.select(
        "cluster_id", F.col("value").alias("state"), "valid_from", "valid_to",
        F.timestamp_diff("MICROSECOND", F.col("valid_from"), F.col("valid_to")).alias("duration_us"))


@query("transition_matrix", """
WITH s AS (
  SELECT state AS to_state, lag(state) OVER w AS from_state, ts, lag(ts) OVER w AS since FROM (
    SELECT * FROM fx_state
    QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY cluster_id ORDER BY ts, event_id)
  ) c WINDOW w AS (PARTITION BY cluster_id ORDER BY ts, event_id)
)
SELECT from_state, to_state, count(*) AS transitions,
       quantile_cont((epoch_us(ts) - epoch_us(since)) // 60000000, 0.5) AS median_dwell
FROM s WHERE from_state IS NOT NULL GROUP BY ALL
""")
def _(fx):
    return transition_matrix(
        fx("fx_state"), ["cluster_id"], EVENT_ORDER, F.col("state"), 60000000, by_minute("ts"))


@query("consecutive_failures", """
WITH g AS (
  SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY instance_id ORDER BY ts, event_id) AS island FROM fx_check
)
SELECT instance_id, ts, event_id, row_number() OVER (PARTITION BY instance_id, island ORDER BY ts, event_id) AS run_length
FROM g WHERE NOT ok
QUALIFY run_length = 5
""")
def _(fx):
    return consecutive_failures(fx("fx_check"), ["instance_id"], EVENT_ORDER, F.col("ok"), 5, by_minute("ts")).drop("ok")


@query("spec_in_force", """
WITH c AS (
  SELECT cluster_id, ts AS spec_ts, state AS spec_state, event_id AS spec_id FROM fx_state
  QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY cluster_id ORDER BY ts, event_id)
), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster_id, spec_ts ORDER BY spec_id DESC) = 1)
SELECT p.instance_id, p.ts, p.event_id, s.spec_ts, s.spec_state, s.spec_id
FROM fx_check p ASOF LEFT JOIN s ON p.instance_id = s.cluster_id AND p.ts >= s.spec_ts
""")
def _(fx):
    # every change of the state is a spec
    specs = change_points(fx("fx_state"), ["cluster_id"], EVENT_ORDER, F.col("state"), by_minute("ts")).select(
        F.col("cluster_id").alias("instance_id"), F.col("ts").alias("spec_ts"), F.col("state").alias("spec_state"),
        F.col("event_id").alias("spec_id"))
    return spec_in_force(
        fx("fx_check").drop("ok"), specs, ["instance_id"], "ts", "spec_ts", ["spec_state", "spec_id"],
        lambda at: ByCount(F.date_trunc("minute", at)), ["spec_id"])


@query("sync_by_priority", """
SELECT cluster_id, slot, priority, state, row_number() OVER (PARTITION BY cluster_id ORDER BY priority NULLS FIRST, slot) AS position
FROM ox_sync
""")
def _(fx):
    rows = sync(fx).select("cluster_id", "slot", "priority", "state")
    return sync_by_priority(rows, ["cluster_id"], ["slot"], F.struct("priority", F.floor(F.col("slot") / 1000)))


@query("fullest_volumes", """
SELECT event_id, instance_id, coalesce(try_cast(replace(usage_text, '%', '') AS DOUBLE), 0) AS usage
FROM fx_usage ORDER BY usage DESC, event_id LIMIT 50
""")
def _(fx):
    top = fullest_volumes(fx("fx_usage"), percent(F.col("usage_text")), ["event_id"], 50)
    return top.select("event_id", "instance_id", "usage")
