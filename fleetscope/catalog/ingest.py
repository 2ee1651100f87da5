"""Sources, sinks and row predicates."""

from pyspark.sql import functions as F

from ..functions.wal import to_text
from ..operators.chunked import by_minute
from ..operators.capacity import percent
from ..operators.predicates import (
    build_text, idle_transactions, is_disconnected, is_ready, job_text, needs_configure, role_label, scope_filter,
    shard_balance, state_summary,
)
from ..operators.switches import availability_switch, storage_guard, stuck_states
from ..sources.audit import minute_batches
from ..sources.backups import backup_history, parse_backup_records
from ..sources.events import event_facts, facts
from ..sources.fleet import with_labels
from ..sources.logs import assemble_multiline, month_counts, tag_lines
from ..sources.probes import parse_probe
from ..sources.reports import parse_lsn, parse_replication
from .common import STATE, SUMMARY, probes
from .registry import query


@query("scan_label_filter", """
SELECT cluster_id, slot, k1, k2, CAST(k3 AS INT) AS k3 FROM fx_probe
WHERE k1 % 4 > 0 AND role_tag = 'standby'
""")
def _(fx):
    labelled = fx("fx_probe").withColumn("labels", F.map_filter(
        F.create_map(
            F.lit("app"), F.when(F.col("k1") % 4 > 0, "db").otherwise("other"),
            F.lit("role"), F.col("role_tag")),
        lambda _k, v: v.isNotNull()))
    found = with_labels(labelled, {"app": "db", "role": "standby"})
    return found.select("cluster_id", "slot", "k1", "k2", F.col("k3").cast("int").alias("k3"))


@query("probe_ingest", """
WITH t AS (SELECT *, k1 % 97 > 0 AND k1 % 89 > 0 AS good FROM fx_probe_json)
SELECT cluster_id, slot, k1, k2, k3, k4, good AS decoded,
       CASE WHEN good THEN f_process ELSE 0 END AS process, CASE WHEN good THEN f_conn ELSE 0 END AS conn,
       CASE WHEN good THEN f_primary ELSE 0 END AS is_primary, CASE WHEN good THEN f_normal ELSE 0 END AS normal,
       CASE WHEN good AND k1 % 2 = 0 THEN build_code ELSE 0 END AS build, 0 AS hang,
       CASE WHEN good THEN detail ELSE '' END AS detail_text
FROM t
""")
def _(fx):
    rows = parse_probe(fx("fx_probe_json").select("cluster_id", "slot", "k1", "k2", "k3", "k4", "probe_text"), "probe_text")
    return rows.select(
        "cluster_id", "slot", "k1", "k2", "k3", "k4", "decoded", F.col("chkprocess").alias("process"),
        F.col("chkconn").alias("conn"), F.col("primary").alias("is_primary"), F.col("chkrepl").alias("normal"),
        F.col("buildstatus").alias("build"), "hang", F.col("detailinfo").alias("detail_text"),
    )


@query("sync_state_extract", """
SELECT cluster_id, slot, k1, k2, k3, k4, ip, CAST(percent AS INT) AS percent, state, priority FROM fx_ha_report WHERE from_primary AND state IS NOT NULL
UNION ALL
SELECT cluster_id, slot, k1, k2, k3, k4, '10.9.9.9', 0, 'Async', 0 FROM fx_ha_report WHERE from_primary AND state IS NOT NULL AND k2 % 5 = 0
""")
def _(fx):
    reports = fx("fx_ha_report").where("from_primary")
    return parse_replication(reports, "report_text", ["cluster_id", "slot", "k1", "k2", "k3", "k4"])


@query("lsn_ingest", """
SELECT cluster_id, slot, k1, k2, CAST(k3 AS INT) AS k3,
       CASE WHEN k1 % 53 = 0 THEN NULL WHEN k1 % 41 = 0 THEN '0,0/0'
            WHEN k1 % 43 = 0 THEN concat('4294967295,0/', k1 % 12)
            ELSE concat(k2 % 2, ',', k2 % 3, '/', k1 % 12) END AS lsn
FROM fx_probe
""")
def _(fx):
    return parse_lsn(fx("fx_probe"), "lsn_text").select(
        "cluster_id", "slot", "k1", "k2", F.col("k3").cast("int").alias("k3"),
        F.when(F.col("lsn").isNotNull(), to_text(F.col("lsn"))).alias("lsn"))


@query("log_tagging", """
SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'auditlog' WHEN 1 THEN 'syslog' ELSE 'omlog' END AS tag,
       concat('c', file_id % 20) AS cluster, concat('10.0.0.', file_id % 7) AS pod_ip,
       len(string_split(text, chr(10))) AS lines, length(replace(text, chr(10), '')) AS chars
FROM fx_file WHERE file_id % 4 < 3
""")
def _(fx):
    lines = fx("fx_file").select("file_id", "path", F.explode(F.split("text", "\n")).alias("line"))
    return tag_lines(lines, "path").groupBy("file_id", "tag", "cluster", "pod_ip").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("multiline_assemble", """
WITH g AS (
  SELECT *, count(*) FILTER (WHERE is_start) OVER (PARTITION BY file_id ORDER BY seq) AS record FROM fx_log
)
SELECT file_id, record, min(seq) AS first_seq, count(*) AS lines, string_agg(text, chr(10) ORDER BY seq) AS text
FROM g GROUP BY file_id, record
""")
def _(fx):
    # a small chunk, so that records cross borders
    return assemble_multiline(fx("fx_log"), ["file_id"], "seq", "text", F.col("is_start"), 3)


@query("log_route_month", """
SELECT tag, strftime(ts, '%Y.%m') AS month, count(*) AS lines, CAST(sum(length(props)) AS BIGINT) AS chars
FROM fx_log_event GROUP BY ALL
""")
def _(fx):
    return month_counts(fx("fx_log_event"), "ts", F.length("props"))


@query("audit_minute_batches", """
SELECT date_trunc('minute', ts) AS period_start, count(*) AS audit_rows, min(event_id) AS first_id, max(event_id) AS last_id
FROM events GROUP BY 1
""")
def _(fx):
    # a poll that overlaps the one before reads some rows twice
    rows = fx("fx_event").select("event_id", "ts")
    return minute_batches(rows.union(rows.where("event_id % 3 = 0")), "ts", "event_id")


@query("backup_history", """
SELECT cluster_id, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(size_bytes) AS BIGINT) AS bytes,
       round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS failure_rate,
       round(quantile_cont(duration_s, 0.5), 3) AS p50_s, round(quantile_cont(duration_s, 0.95), 3) AS p95_s
FROM fx_backup GROUP BY cluster_id
""")
def _(fx):
    records = parse_backup_records(fx("fx_backup_text").select("cluster_id", "record_text"), "record_text")
    return backup_history(records, ["cluster_id"])


@query("event_facts", """
SELECT instance_id, ts, 'Normal' AS type, 'SetDefaultTransaction' AS reason,
       'storage threshold reached, read-only set to ON' AS message FROM q_storage_guard WHERE switch = 'ON'
UNION ALL
SELECT cluster_id, switched_at, 'Normal', 'SetMostAvailable', concat('availability mode set to ', switch) FROM q_availability_switch
UNION ALL
SELECT cluster_id, timeout_at, 'Warning', 'InstanceStartTimeout', concat('instance ', cluster_id, ' did not start in time')
FROM q_stuck_states
""")
def _(fx):
    key = ["instance_id"]
    full = storage_guard(fx("fx_usage"), key, ["ts", "event_id"], percent(F.col("usage_text")), by_minute("ts")).where("switch = 'ON'")
    mode = availability_switch(
        fx("fx_sync_count"), ["cluster_id"], ["ts", "event_id"], F.col("synced"), F.col("expected"), 60, by_minute("ts")
    ).withColumnRenamed("cluster_id", "instance_id")
    stuck = stuck_states(
        fx("fx_state"), ["cluster_id"], ["ts", "event_id"], F.col("state"), ["creating", "updating", "recovering"], 300,
        by_minute("ts"),
    ).withColumnRenamed("cluster_id", "instance_id")
    return event_facts(fx.spark, [
        facts(full, key, F.col("ts"), "SetDefaultTransaction", F.col("switch")),
        facts(mode, key, F.col("switched_at"), "SetMostAvailable", F.col("switch")),
        facts(stuck, key, F.col("timeout_at"), "InstanceStartTimeout", F.col("instance_id")),
    ], key)


@query("scope_filter", """
SELECT 'include' AS mode, cluster_id, namespace_id FROM fx_cluster WHERE namespace_id IN (1, 2, 3, 5, 8, 13)
UNION ALL
SELECT 'exclude', cluster_id, namespace_id FROM fx_cluster WHERE namespace_id NOT IN (1, 2, 3)
""")
def _(fx):
    clusters = fx("fx_cluster").select("cluster_id", "namespace_id", F.col("namespace_id").cast("string").alias("ns"))
    kept = scope_filter(clusters, "ns", include=" 1, 2,,3 ,5,8,13 ", exclude="1")
    rest = scope_filter(clusters, "ns", exclude="1,2 ,3")
    return kept.withColumn("mode", F.lit("include")).union(rest.withColumn("mode", F.lit("exclude"))).drop("ns")


@query("shard_balance", """
WITH h AS (
  SELECT list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(concat(namespace_id, cluster_id), ''),
           lambda c: CAST(ord(c) AS HUGEINT))),
           lambda a, b: (a * 31 + b) % 18446744073709551616) AS u
  FROM fx_cluster
), s AS (
  SELECT CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616 - u ELSE u END % 64 AS b FROM h
)
SELECT CAST(b // 16 AS BIGINT) AS shard, count(*) AS clusters FROM s GROUP BY 1
""")
def _(fx):
    return shard_balance(fx("fx_cluster"), ["namespace_id", "cluster_id"], 4, 16)


@query("needs_configure", """
SELECT cluster_id, slot FROM ox_latest
WHERE f_process <> 1 OR f_conn <> 1 OR f_normal <> 1 OR f_pending = 1 OR f_standalone = 1 OR f_hang = 1
""")
def _(fx):
    return probes(fx, *STATE).where(needs_configure()).select("cluster_id", "slot")


@query("instance_condition_flags", """
SELECT cluster_id, slot, f_normal <> 1 AND detail IN ('Disconnected', 'Connecting...') AS disconnected,
       phase = 'Running' AND port_open AS ready,
       NOT (f_process = 1 AND f_conn = 1 AND f_normal = 1 AND f_pending = 0 AND f_standalone = 0 AND f_hang = 0) AS unconfigured
FROM ox_latest
""")
def _(fx):
    return probes(fx, *STATE, "detailinfo", "phase", "port_open").select(
        "cluster_id", "slot", is_disconnected().alias("disconnected"), is_ready().alias("ready"),
        needs_configure().alias("unconfigured"))


@query("role_label", """
SELECT cluster_id, slot, CASE WHEN f_primary = 1 THEN 'Primary' WHEN f_standby = 1 THEN 'Standby'
       WHEN f_pending = 1 THEN 'Pending' WHEN f_standalone = 1 THEN 'Standalone' ELSE 'None' END AS role
FROM ox_latest
""")
def _(fx):
    return probes(fx, "primary", "standby", "pending", "standalone").select("cluster_id", "slot", role_label().alias("role"))


@query("decode_status", """
SELECT cluster_id, slot, k1, k2, CAST(k3 AS INT) AS k3, coalesce(b.t, 'unknown') AS build, coalesce(u.t, 'no data') AS backup, coalesce(r.t, 'no data') AS restored
FROM fx_probe
LEFT JOIN (VALUES (0, 'Build completed'), (1, 'Build failed'), (2, 'Building'), (3, 'no begin')) b(c, t) ON b.c = build_code
LEFT JOIN (VALUES (1, 'complete'), (2, 'failed'), (3, 'in process')) u(c, t) ON u.c = backup_code
LEFT JOIN (VALUES (1, 'complete'), (2, 'failed'), (3, 'in process')) r(c, t) ON r.c = restore_code
""")
def _(fx):
    return fx("fx_probe").select(
        "cluster_id", "slot", "k1", "k2", F.col("k3").cast("int").alias("k3"), build_text(F.col("build_code")).alias("build"),
        job_text(F.col("backup_code")).alias("backup"), job_text(F.col("restore_code")).alias("restored"))


@query("state_summary", """
SELECT cluster_id, slot, format('[Local Role: {}, Process exist: {}, Connection available: {}, DB state normal: {}, Maintenance: {}, Build status: {}, Backup status: {}, Restore status: {}, Static Connections: {}, {}]',
  CASE WHEN f_primary = 1 THEN 'Primary' WHEN f_standby = 1 THEN 'Standby' WHEN f_pending = 1 THEN 'Pending'
       WHEN f_standalone = 1 THEN 'Standalone' ELSE 'None' END,
  CAST(f_process = 1 AS VARCHAR), CAST(f_conn = 1 AS VARCHAR), CAST(f_normal = 1 AS VARCHAR), CAST(f_maint = 1 AS VARCHAR),
  CASE build_code WHEN 0 THEN 'Build completed' WHEN 1 THEN 'Build failed' WHEN 2 THEN 'Building' WHEN 3 THEN 'no begin' ELSE 'unknown' END,
  CASE backup_code WHEN 1 THEN 'complete' WHEN 2 THEN 'failed' WHEN 3 THEN 'in process' ELSE 'no data' END,
  CASE restore_code WHEN 1 THEN 'complete' WHEN 2 THEN 'failed' WHEN 3 THEN 'in process' ELSE 'no data' END,
  connections, CASE WHEN detail <> '' THEN concat('Detail Information: ', detail, ', ') ELSE '' END) AS summary
FROM ox_latest
""")
def _(fx):
    return probes(fx, *SUMMARY).select("cluster_id", "slot", state_summary().alias("summary"))


@query("idle_transactions", """
SELECT sessionid, instance_id FROM fx_session
WHERE state = 'idle in transaction' AND TIMESTAMP '2024-01-12 00:00:00' - state_change > INTERVAL 24 HOUR
  AND instance_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
""")
def _(fx):
    primaries = fx.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("instance_id"))
    now = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    return idle_transactions(fx("fx_session"), primaries, now, 24, ["instance_id"]).select("sessionid", "instance_id")
