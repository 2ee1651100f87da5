"""Verdicts per cluster."""

from pyspark.sql import functions as F

from ..operators.health import (
    all_members_ready, cluster_health, distinct_members, event_levels, event_rollup, fleet_members, instance_condition, node_states,
    primary_cardinality, replica_sync_gap,
)
from ..operators.predicates import state_summary
from .common import KEY, SUMMARY, probes, sync
from ..operators.drift import extend_ip_rollup
from .drift import extend_ip_inputs, named_clusters
from .registry import query, view

view("ox_inst", """
SELECT *, phase = 'Running' AND port_open AS up,
       f_process <> 1 OR f_conn <> 1 OR f_normal <> 1 OR f_pending = 1 OR f_standalone = 1 OR f_hang = 1 AS nc,
       role_tag IS NULL OR (f_primary = 1 AND role_tag <> 'primary') OR (f_standby = 1 AND role_tag <> 'standby') AS ml
FROM ox_latest
""")


@query("cluster_health", """
WITH m AS (
  SELECT cluster_id, count(*) FILTER (WHERE seen_ip IS NULL) AS members_missing,
         count(*) FILTER (WHERE want_ip IS NULL) AS members_beyond FROM ox_pair GROUP BY 1
), i AS (
  SELECT cluster_id,
    count(*) FILTER (WHERE NOT up OR (f_maint = 0 AND nc) OR (ml AND (f_maint = 1 OR NOT nc))) AS not_ready,
    count(*) FILTER (WHERE up AND f_maint = 1) AS in_maintenance,
    count(*) FILTER (WHERE up AND (f_maint = 1 OR NOT nc) AND ml) AS mislabelled,
    count(*) FILTER (WHERE up AND (f_maint = 1 OR NOT nc) AND NOT ml AND k2 % 2 = 1) AS state_changed,
    count(*) FILTER (WHERE up AND f_primary = 1) AS primaries,
    min(ip) FILTER (WHERE up AND f_primary = 1) AS pip
  FROM ox_inst GROUP BY 1
), a AS (SELECT cluster_id, count(*) AS artifacts_missing FROM q_missing_artifacts GROUP BY 1),
x AS (SELECT cluster_id, count(*) AS extend_ip_wrong FROM q_extend_ip_drift GROUP BY 1),
f AS (
  SELECT c.cluster_id, c.local_role, c.recorded_primary, coalesce(members_missing, 0) AS members_missing,
         coalesce(members_beyond, 0) AS members_beyond, coalesce(not_ready, 0) AS not_ready,
         coalesce(in_maintenance, 0) AS in_maintenance, coalesce(mislabelled, 0) AS mislabelled,
         coalesce(state_changed, 0) AS state_changed, coalesce(primaries, 0) AS primaries,
         coalesce(artifacts_missing, 0) AS artifacts_missing, coalesce(extend_ip_wrong, 0) AS extend_ip_wrong, pip
  FROM fx_cluster c LEFT JOIN m USING (cluster_id) LEFT JOIN i USING (cluster_id) LEFT JOIN a USING (cluster_id) LEFT JOIN x USING (cluster_id)
), g AS (
  SELECT *, members_missing + members_beyond > 0 AS drift,
    CASE WHEN local_role = 'primary' THEN NOT coalesce(primaries = 1 AND pip = recorded_primary
           AND EXISTS (SELECT 1 FROM fx_member x WHERE x.cluster_id = f.cluster_id AND x.ip = f.pip), false)
         ELSE primaries > 0 END AS bad_primary FROM f
)
SELECT cluster_id, members_missing, members_beyond, not_ready, in_maintenance, mislabelled, state_changed, primaries, artifacts_missing, extend_ip_wrong,
  in_maintenance > 0 OR drift OR bad_primary OR not_ready > 0 OR artifacts_missing > 0 OR extend_ip_wrong > 0 AS needs_reconcile,
  NOT drift AND artifacts_missing = 0 AS resource_ready,
  NOT (in_maintenance > 0 OR drift OR bad_primary OR not_ready > 0) AS instances_ready,
  NOT bad_primary AND artifacts_missing = 0 AS service_ready,
  concat_ws(',', CASE WHEN in_maintenance > 0 THEN 'maintenance' END, CASE WHEN drift THEN 'members' END,
    CASE WHEN bad_primary THEN 'primary' END, CASE WHEN not_ready > 0 THEN 'not_ready' END,
    CASE WHEN artifacts_missing > 0 THEN 'artifacts' END, CASE WHEN extend_ip_wrong > 0 THEN 'extend_ip' END) AS causes
FROM g
""")
def _(fx):
    return health_of(fx)


def health_of(fx):
    latest = probes(fx, "ip", "phase", "port_open", "role_tag", "hang", *SUMMARY)
    recorded = F.when(F.col("k2") % 2 == 0, state_summary()).otherwise("older")
    instances = latest.select("cluster_id", "ip", *instance_condition(F.col("role_tag"), recorded, state_summary()))
    return cluster_health(named_clusters(fx), fx("fx_member"), instances, fx("fx_artifact"), KEY, extend_ip_rollup(*extend_ip_inputs(fx), KEY))


@query("primary_cardinality", """
WITH p AS (
  SELECT cluster_id, count(*) AS n, min(ip) AS pip FROM ox_latest WHERE f_primary = 1 GROUP BY 1
)
SELECT c.cluster_id, coalesce(n, 0) AS primaries,
       CASE WHEN n > 1 OR (n = 1 AND local_role = 'standby') THEN 'multiple' WHEN n = 1 THEN 'one'
            WHEN local_role = 'standby' THEN 'expected_none' ELSE 'none' END AS verdict,
       coalesce(n = 1 AND NOT EXISTS (SELECT 1 FROM fx_member m WHERE m.cluster_id = c.cluster_id AND m.ip = pip), false) AS primary_not_member,
       coalesce(n = 1 AND pip <> recorded_primary, false) AS primary_not_recorded
FROM fx_cluster c LEFT JOIN p USING (cluster_id)
""")
def _(fx):
    latest = probes(fx, "ip", "primary").select("cluster_id", "ip", (F.col("primary") == 1).alias("is_primary"))
    return primary_cardinality(fx("fx_cluster"), fx("fx_member"), latest, KEY)


@query("replica_sync_gap", """
WITH s AS (SELECT cluster_id, count(*) FILTER (WHERE state = 'Sync') AS n FROM ox_sync GROUP BY 1),
e AS (SELECT cluster_id, CASE WHEN remote_count > 0 THEN want_slots WHEN want_slots >= 2 THEN want_slots // 2 ELSE 0 END AS expected FROM fx_cluster)
SELECT cluster_id, expected, coalesce(n, 0) AS synced, expected - coalesce(n, 0) AS gap FROM e LEFT JOIN s USING (cluster_id)
""")
def _(fx):
    return replica_sync_gap(fx("fx_cluster"), sync(fx), KEY, "want_slots", "remote_count")


@query("distinct_members", """
SELECT cluster_id, count(*) AS members, CAST(sum(n) AS BIGINT) AS entries, count(*) FILTER (WHERE n > 1) AS duplicated FROM (
  SELECT cluster_id, ip, count(*) AS n FROM fx_probe WHERE k1 % 19 > 0 GROUP BY 1, 2) t GROUP BY 1
""")
def _(fx):
    listed = fx("fx_probe").select("cluster_id", F.when(F.col("k1") % 19 > 0, F.col("ip")).otherwise("").alias("ip"))
    return distinct_members(listed, KEY, "ip")


@query("fleet_members", """
WITH l AS (SELECT namespace_id, cluster_id, ip FROM fx_member JOIN fx_cluster USING (cluster_id))
SELECT namespace_id, grouping(namespace_id) = 1 AS is_fleet, count(DISTINCT cluster_id) AS clusters, count(DISTINCT ip) AS members, count(*) AS entries,
       true AS sketch_holds
FROM l GROUP BY ROLLUP (namespace_id)
""")
def _(fx):
    listed = fx("fx_member").join(fx("fx_cluster").select("cluster_id", "namespace_id"), KEY)
    totals = fleet_members(listed, "namespace_id", KEY, "ip")
    # three standard errors of the sketch, and one member of rounding
    holds = F.abs(F.col("estimated") - F.col("members")) <= 1 + 0.05 * F.col("members")
    return totals.withColumn("sketch_holds", holds).drop("estimated")


@query("event_levels", """
SELECT date_trunc('hour', ts) AS bucket, cluster_id, type, reason, CAST(grouping_id(date_trunc('hour', ts), cluster_id, type, reason) AS BIGINT) AS level,
       count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen
FROM fx_event GROUP BY ROLLUP (date_trunc('hour', ts), cluster_id, type, reason)
""")
def _(fx):
    return event_levels(fx("fx_event"), "ts", "hour", ["cluster_id", "type", "reason"])


@query("event_rollup", """
SELECT date_trunc('hour', ts) AS bucket, cluster_id, type, reason, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen
FROM fx_event GROUP BY ALL
""")
def _(fx):
    return event_rollup(fx("fx_event"), "ts", "hour", ["cluster_id", "type", "reason"])


@query("node_state_map", """
WITH i AS (
  SELECT cluster_id, slot, ip, phase = 'Running' AS up, concat(phase, '/', role_tag) AS s FROM ox_latest
), k AS (SELECT cluster_id, ip FROM fx_member UNION SELECT cluster_id, ip FROM i WHERE up)
SELECT k.cluster_id, k.ip, coalesce(i.s, 'unknown') AS node_state FROM k LEFT JOIN i ON i.cluster_id = k.cluster_id AND i.ip = k.ip
""")
def _(fx):
    state = F.concat("phase", F.lit("/"), F.coalesce("role_tag", F.lit("")))
    name = F.concat(F.lit("og-"), "cluster_id", F.lit("-pod-"), F.replace("ip", F.lit("."), F.lit("x")))
    instances = probes(fx, "ip", "phase", "role_tag").select(
        "cluster_id", name.alias("name"), F.when(F.col("phase") == "Running", F.col("ip")).otherwise("").alias("ip"),
        state.alias("node_state"))
    named = fx("fx_member").withColumn("cluster_name", F.col("cluster_id"))
    return node_states(named, instances, KEY, "cluster_id")


@query("all_members_ready", """
WITH j AS (
  SELECT coalesce(m.cluster_id, p.cluster_id) AS cluster_id, m.ip IS NOT NULL AS w, p.ip IS NOT NULL AS o,
         coalesce(p.phase = 'Running' AND p.port_open, false) AS r
  FROM fx_member m FULL JOIN ox_latest p ON m.cluster_id = p.cluster_id AND m.ip = p.ip
)
SELECT cluster_id, count(*) FILTER (WHERE w) AS desired, count(*) FILTER (WHERE r) AS ready,
       bool_and(NOT o OR r) AND bool_and(NOT w OR r) AND bool_or(o) AS all_ready
FROM j GROUP BY 1
""")
def _(fx):
    instances = probes(fx, "ip", "phase", "port_open").select(
        "cluster_id", "ip", ((F.col("phase") == "Running") & F.col("port_open")).alias("ready"))
    return all_members_ready(fx("fx_member"), instances, KEY)
