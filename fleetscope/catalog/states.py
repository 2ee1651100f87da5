"""Switches, deadlines and outcomes over histories (batch forms of the streams)."""

from pyspark.sql import functions as F

from ..operators.chunked import by_minute
from ..operators.capacity import log_retention, percent
from ..operators.history import build_outcomes, job_outcomes, recovery_outcomes
from ..operators.switches import availability_switch, missed_gaps, poll_coverage, storage_guard, stuck_states
from .registry import query

ORDER = ["ts", "event_id"]


@query("storage_guard", """
WITH f AS (
  SELECT *, coalesce(try_cast(replace(usage_text, '%', '') AS DOUBLE), 0) >= 95 AS on_now FROM fx_usage
)
SELECT instance_id, ts, event_id, CASE WHEN on_now THEN 'ON' ELSE 'OFF' END AS switch FROM f
QUALIFY on_now <> coalesce(lag(on_now) OVER (PARTITION BY instance_id ORDER BY ts, event_id), false)
""")
def _(fx):
    return storage_guard(fx("fx_usage"), ["instance_id"], ORDER, percent(F.col("usage_text")), by_minute("ts"))


@query("availability_switch", """
WITH s AS (
  SELECT *, CASE WHEN expected = 0 THEN 'lone' WHEN synced < expected THEN 'short' WHEN synced = expected THEN 'reached'
            ELSE 'over' END AS sig,
         max(ts) OVER () AS last_ts
  FROM fx_sync_count
), i AS (
  SELECT * FROM s QUALIFY sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY cluster_id ORDER BY ts, event_id)
), e AS (
  SELECT *, lead(ts) OVER (PARTITION BY cluster_id ORDER BY ts, event_id) AS until_ts FROM i
), d AS (
  SELECT cluster_id, ts AS switched_at, false AS m, ts, event_id FROM e WHERE sig = 'reached'
  UNION ALL SELECT cluster_id, ts, true, ts, event_id FROM e WHERE sig = 'lone'
  UNION ALL SELECT cluster_id, ts + INTERVAL 60 SECOND, true, ts, event_id FROM e
    WHERE sig = 'short' AND CASE WHEN until_ts IS NULL THEN ts + INTERVAL 60 SECOND <= last_ts ELSE ts + INTERVAL 60 SECOND < until_ts END
)
SELECT cluster_id, switched_at, CASE WHEN m THEN 'ON' ELSE 'OFF' END AS switch FROM d
QUALIFY m <> coalesce(lag(m) OVER (PARTITION BY cluster_id ORDER BY switched_at, ts, event_id), false)
""")
def _(fx):
    return availability_switch(
        fx("fx_sync_count"), ["cluster_id"], ORDER, F.col("synced"), F.col("expected"), 60, by_minute("ts"))


@query("stuck_states", """
WITH c AS (
  SELECT cluster_id, ts, event_id, state, max(ts) OVER () AS last_ts FROM fx_state
  QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY cluster_id ORDER BY ts, event_id)
), v AS (SELECT *, lead(ts) OVER (PARTITION BY cluster_id ORDER BY ts, event_id) AS valid_to FROM c)
SELECT cluster_id, state, ts AS valid_from, ts + INTERVAL 300 SECOND AS timeout_at, valid_to IS NULL AS still_open
FROM v WHERE state IN ('creating', 'updating', 'recovering') AND coalesce(valid_to, last_ts) - ts > INTERVAL 300 SECOND
""")
def _(fx):
    return stuck_states(
        fx("fx_state"), ["cluster_id"], ORDER, F.col("state"), ["creating", "updating", "recovering"], 300,
        by_minute("ts"))


@query("recovery_outcomes", """
WITH g AS (
  SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY instance_id ORDER BY ts, event_id) AS island FROM fx_check
), r AS (
  SELECT *, row_number() OVER (PARTITION BY instance_id, island, ok ORDER BY ts, event_id) AS n FROM g
), b AS (
  SELECT *, lag(CASE WHEN ok THEN 0 ELSE n END) OVER (PARTITION BY instance_id ORDER BY ts, event_id) AS before_n FROM r
)
SELECT instance_id, ts, event_id, 'complete' AS outcome, before_n AS tries FROM b WHERE ok AND before_n BETWEEN 1 AND 3
UNION ALL
SELECT instance_id, ts, event_id, 'fail', n FROM b WHERE NOT ok AND n = 4
""")
def _(fx):
    return recovery_outcomes(fx("fx_check"), ["instance_id"], ORDER, F.col("ok"), 3, by_minute("ts"))


@query("job_outcomes", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ts, event_id) AS n FROM fx_job),
t AS (
  SELECT attempt_id, count(*) AS checks, min(n) FILTER (WHERE job_code = 1) AS done,
         min(n) FILTER (WHERE job_code IN (0, 2) AND n - 1 > 30) AS failed FROM r GROUP BY 1
)
SELECT attempt_id, 'backup' AS kind,
       CASE WHEN done IS NULL AND failed IS NULL THEN 'running' WHEN failed IS NULL OR done < failed THEN 'success' ELSE 'fail' END AS outcome,
       coalesce(least(done, failed), checks) AS checks
FROM t
UNION ALL
SELECT attempt_id, 'build', outcome, checks FROM (
  WITH q AS (
    SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ts, event_id) AS n,
      count(*) FILTER (WHERE build_code <> 2) OVER (PARTITION BY attempt_id ORDER BY ts, event_id) - 1 AS waits FROM fx_job
  ), z AS (
    SELECT *, CASE WHEN build_code = 1 THEN 'fail' WHEN build_code = 0 AND is_standby AND is_normal THEN 'success'
      WHEN build_code = 0 AND NOT is_normal AND waits > 30 THEN 'success_not_normal' END AS o FROM q
  )
  SELECT attempt_id, coalesce(arg_min(o, n) FILTER (WHERE o IS NOT NULL), 'running') AS outcome,
         coalesce(min(n) FILTER (WHERE o IS NOT NULL), count(*)) AS checks FROM z GROUP BY 1
) b
""")
def _(fx):
    jobs = fx("fx_job")
    key = ["attempt_id"]
    backup = job_outcomes(jobs, key, ORDER, "job_code", 30, by_minute("ts")).withColumn("kind", F.lit("backup"))
    build = build_outcomes(
        jobs, key, ORDER, "build_code", F.col("is_standby"), F.col("is_normal"), 30, by_minute("ts")
    ).withColumn("kind", F.lit("build"))
    return backup.unionByName(build)


@query("poll_coverage", """
WITH s AS (SELECT instance_id, epoch_us(ts) // 60000000 AS slot FROM fx_check)
SELECT instance_id, count(*) AS polls, count(DISTINCT slot) AS covered, max(slot) - min(slot) + 1 - count(DISTINCT slot) AS missed
FROM s GROUP BY 1
""")
def _(fx):
    return poll_coverage(fx("fx_check"), ["instance_id"], "ts", 60)


@query("poll_gaps", """
WITH s AS (SELECT DISTINCT instance_id, epoch_us(ts) // 60000000 AS slot FROM fx_check)
SELECT instance_id, prev AS after_slot, slot - prev - 1 AS missed FROM (
  SELECT *, lag(slot) OVER (PARTITION BY instance_id ORDER BY slot) AS prev FROM s
) t WHERE slot - prev > 1
""")
def _(fx):
    return missed_gaps(fx("fx_check"), ["instance_id"], "ts", 60, 1440)


@query("log_retention", """
SELECT cluster_id, CASE WHEN age_days > 3 THEN 'drop' WHEN age_days > 1 THEN 'compress' ELSE 'keep' END AS action,
       count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
FROM fx_file GROUP BY ALL
""")
def _(fx):
    return log_retention(fx("fx_file"), ["cluster_id"], F.col("age_days"))
