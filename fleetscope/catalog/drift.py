"""Desired against actual."""

from pyspark.sql import functions as F

from ..operators.capacity import capacity_drift
from ..operators.drift import (
    bandwidth_annotations, complete_instances, env_drift, extend_ip_drift, extend_ip_rollup, instance_spec_drift, label_role_mismatch, member_except,
    member_intersect, member_union, membership_drift, missing_artifacts, mount_failures, mount_wait_exemption,
    restart_required, service_drift, sync_standbys,
)
from ..operators.predicates import label_mismatch
from ..operators.replication import acl_drift, edge_drift, replication_edges, sync_policy, topology
from .common import KEY, probes, sync
from .registry import query, view

view("ox_pair", """
SELECT coalesce(m.cluster_id, p.cluster_id) AS cluster_id, m.ip AS want_ip, p.ip AS seen_ip
FROM (SELECT DISTINCT cluster_id, ip FROM fx_member) m
FULL JOIN (SELECT DISTINCT cluster_id, ip FROM fx_probe) p ON m.cluster_id = p.cluster_id AND m.ip = p.ip
""")
view("fx_mount_event", """
SELECT cluster_id, slot, CASE k2 % 4 WHEN 0 THEN 'FailedMount' WHEN 1 THEN 'FailedAttachVolume' WHEN 2 THEN 'Pulled'
       ELSE 'Scheduled' END AS reason
FROM fx_probe
""")


@query("membership_drift", """
SELECT cluster_id, count(*) FILTER (WHERE seen_ip IS NULL) AS missing, count(*) FILTER (WHERE want_ip IS NULL) AS beyond,
       count(*) FILTER (WHERE want_ip = seen_ip) AS common,
       bool_and(want_ip IS NOT NULL AND seen_ip IS NOT NULL) AS equal, bool_and(seen_ip IS NOT NULL) AS covers_desired
FROM ox_pair GROUP BY cluster_id
""")
def _(fx):
    return membership_drift(fx("fx_member"), fx("fx_probe"), KEY, "ip")


@query("member_union", "SELECT DISTINCT cluster_id, coalesce(want_ip, seen_ip) AS ip FROM ox_pair")
def _(fx):
    return member_union(fx("fx_member"), fx("fx_probe"), ["cluster_id", "ip"])


@query("member_except", """
SELECT cluster_id, coalesce(want_ip, seen_ip) AS ip, CASE WHEN want_ip IS NULL THEN 'beyond' ELSE 'missing' END AS side
FROM ox_pair WHERE want_ip IS NULL OR seen_ip IS NULL
""")
def _(fx):
    return member_except(fx("fx_member"), fx("fx_probe"), KEY, "ip")


@query("member_intersect", "SELECT cluster_id, count(*) AS common FROM ox_pair WHERE want_ip = seen_ip GROUP BY cluster_id")
def _(fx):
    return member_intersect(fx("fx_member"), fx("fx_probe"), KEY, "ip")


@query("label_role_mismatch", """
SELECT cluster_id, slot, role_tag FROM ox_latest
WHERE role_tag IS NULL OR (f_primary = 1 AND role_tag <> 'primary') OR (f_standby = 1 AND role_tag <> 'standby')
""")
def _(fx):
    latest = probes(fx, "role_tag", "primary", "standby")
    instances = latest.select("cluster_id", "slot", "role_tag")
    states = latest.select("cluster_id", "slot", "primary", "standby")
    found = label_role_mismatch(instances, states, ["cluster_id", "slot"], label_mismatch(F.col("role_tag")))
    return found.select("cluster_id", "slot", "role_tag")


@query("sync_standbys", """
SELECT p.cluster_id, p.ip FROM ox_latest p JOIN ox_sync s ON p.cluster_id = s.cluster_id AND p.ip = s.ip
WHERE p.f_standby = 1 AND s.state = 'Sync'
""")
def _(fx):
    standbys = probes(fx, "ip", "standby").where("standby = 1").select("cluster_id", "ip")
    return sync_standbys(standbys, sync(fx), ["cluster_id", "ip"])


@query("complete_instances", """
SELECT p.cluster_id, p.ip FROM ox_latest p LEFT JOIN ox_sync s ON p.cluster_id = s.cluster_id AND p.ip = s.ip
JOIN fx_cluster c ON c.cluster_id = p.cluster_id
WHERE s.state = 'Sync' OR p.ip = c.recorded_primary
""")
def _(fx):
    primary = fx("fx_cluster").select("cluster_id", F.col("recorded_primary").alias("ip"))
    return complete_instances(probes(fx, "ip").select("cluster_id", "ip"), sync(fx), primary, KEY)


@query("missing_artifacts", """
WITH want AS (
  SELECT cluster_id, namespace_id AS namespace, 'ConfigMap' AS kind, concat('og-', cluster_id, '-cm') AS artifact FROM fx_cluster
  UNION ALL SELECT cluster_id, namespace_id, 'ConfigMap', 'script-config' FROM fx_cluster
  UNION ALL SELECT cluster_id, namespace_id, 'ConfigMap', 'log-config' FROM fx_cluster
  UNION ALL SELECT cluster_id, namespace_id, 'Secret', concat(cluster_id, '-init-sc') FROM fx_cluster
  UNION ALL SELECT cluster_id, namespace_id, 'Service', concat('og-', cluster_id, '-svc-read') FROM fx_cluster
  UNION ALL SELECT cluster_id, namespace_id, 'Service', concat('og-', cluster_id, '-svc') FROM fx_cluster
)
SELECT * FROM want w WHERE NOT EXISTS (
  SELECT 1 FROM fx_artifact a WHERE a.namespace = w.namespace AND a.kind = w.kind AND a.artifact = w.artifact)
""")
def _(fx):
    return missing_artifacts(named_clusters(fx), fx("fx_artifact"), KEY)


def named_clusters(fx):
    return fx("fx_cluster").withColumns({
        "namespace": F.col("namespace_id"), "name": F.col("cluster_id"),
        "script_config": F.lit("script-config"), "log_config": F.lit("log-config"),
    })


@query("service_drift", """
WITH s AS (
  SELECT *, CASE WHEN is_write THEN 31000 ELSE 30000 END + cluster_id % 1000 AS want_port,
         CASE WHEN is_write THEN 'primary' ELSE 'standby' END AS want_role FROM fx_service
)
SELECT cluster_id, is_write AS "write", 'node_port' AS field FROM s WHERE node_port <> want_port
UNION ALL SELECT cluster_id, is_write, 'port' FROM s WHERE port <> 5432
UNION ALL SELECT cluster_id, is_write, 'target_port' FROM s WHERE target_port <> 5432
UNION ALL SELECT cluster_id, is_write, 'selector' FROM s WHERE select_role <> want_role
""")
def _(fx):
    clusters = fx("fx_cluster").select(
        "cluster_id", F.col("cluster_id").alias("name"), (F.col("cluster_id") % 1000 + 30000).cast("int").alias("read_port"),
        (F.col("cluster_id") % 1000 + 31000).cast("int").alias("write_port"), F.lit(5432).alias("db_port"))
    services = fx("fx_service").select(
        "cluster_id", F.col("is_write").alias("write"), "node_port", "port", "target_port",
        F.create_map(F.lit("role"), F.col("select_role"), F.lit("cluster"), F.col("cluster_id").cast("string")).alias("selector"))
    return service_drift(clusters, services, KEY)


@query("instance_spec_drift", """
WITH j AS (
  SELECT i.*, s.* EXCLUDE (cluster_id), i.k2 AS n FROM fx_inst i JOIN fx_inst_spec s ON i.cluster_id = s.cluster_id
), r AS (
  SELECT cluster_id, instance_id, slot, q, k2, concat_ws(',',
    CASE WHEN applied_available_timeout = 0 THEN 'never_scheduled' END,
    CASE WHEN image <> want_image THEN 'image' END,
    CASE WHEN n % 4 = 1 THEN 'cpu' END,
    CASE WHEN n % 5 = 1 THEN 'memory' END,
    CASE WHEN readiness_period <> want_readiness_period THEN 'readiness_period' END,
    CASE WHEN sidecar_image <> CASE WHEN want_sidecar_image = '' THEN want_image ELSE want_sidecar_image END THEN 'sidecar_image' END,
    CASE WHEN network_class <> 'kube-ovn' AND (bandwidth IS NULL) <> (want_bandwidth = '') THEN 'bandwidth' END,
    CASE WHEN mode <> want_mode THEN 'env' END,
    CASE WHEN sidecar_var <> 'CR_NAME' THEN 'sidecar_env' END,
    CASE WHEN network_class = 'kube-ovn' AND extend_ip <> '' AND (want_networks IS NULL OR note IS NULL OR note <> extend_ip) THEN 'extend_ip' END,
    CASE WHEN config IS NULL OR config <> want_config OR script_config <> 'script' THEN 'config' END) AS reasons FROM j
)
SELECT cluster_id, concat(instance_id, '/', slot, '/', q, '/', k2) AS ip, reasons FROM r WHERE reasons <> ''
""")
def _(fx):
    none = F.create_map().cast("map<string,string>")
    instances = fx("fx_inst").withColumns({
        "ip": F.concat_ws("/", "instance_id", "slot", "q", "k2"),
        "container_env": F.create_map(F.lit("MODE"), F.col("mode")), "sidecar_env": F.create_map(F.col("sidecar_var"), F.lit("x")),
        "annotations": F.when(F.col("note").isNotNull(), F.create_map(F.lit("net1.ns1.ovn.kubernetes.io/ip_address"), F.col("note"))).otherwise(none),
        "configs": F.map_filter(
            F.create_map(F.lit("cluster"), F.col("config"), F.lit("script"), F.col("script_config"), F.lit("log"), F.lit("log")), lambda _k, v: v.isNotNull()),
    })
    wanted = fx("fx_inst_spec").withColumns({
        "want_env": F.create_map(F.lit("og_MODE"), F.col("want_mode")),
        "spec_annotations": F.when(F.col("want_networks").isNotNull(), F.create_map(F.lit("k8s.v1.cni.cncf.io/networks"), F.col("want_networks"))).otherwise(none),
        "want_configs": F.create_map(F.lit("cluster"), F.col("want_config"), F.lit("script"), F.lit("script"), F.lit("log"), F.lit("log")),
    })
    return instance_spec_drift(wanted, instances.drop("instance_id", "slot", "q", "k2"), KEY)


@query("env_drift", """
WITH w AS (
  SELECT cluster_id, key1 AS k, val1 AS v FROM fx_env_spec UNION ALL SELECT cluster_id, key2, val2 FROM fx_env_spec
), h AS (
  SELECT instance_id, cluster_id, container, name1 AS n, env1 AS v FROM fx_env_inst
  UNION ALL SELECT instance_id, cluster_id, container, name2, env2 FROM fx_env_inst
), c AS (SELECT i.*, w.k, w.v FROM fx_env_inst i JOIN w USING (cluster_id) WHERE starts_with(w.k, i.container)),
m AS (
  SELECT instance_id FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.instance_id = c.instance_id AND contains(c.k, h.n))
), d AS (
  SELECT c.instance_id FROM c JOIN h ON h.instance_id = c.instance_id WHERE contains(c.k, h.n) AND h.v <> c.v
), x AS (
  SELECT instance_id FROM h WHERE n NOT IN ('OG_PASSWORD', 'MY_POD_IP', 'CR_NAME')
    AND NOT EXISTS (SELECT 1 FROM w WHERE w.cluster_id = h.cluster_id AND w.k = concat(h.container, '_', h.n))
)
SELECT * FROM (
  SELECT instance_id, cluster_id, container, instance_id IN (SELECT * FROM m) AS missing,
         instance_id IN (SELECT * FROM d) AS changed, instance_id IN (SELECT * FROM x) AS extra
  FROM fx_env_inst WHERE cluster_id IN (SELECT cluster_id FROM fx_env_spec)
) t WHERE missing OR changed OR extra
""")
def _(fx):
    specs = fx("fx_env_spec").select("cluster_id", F.create_map("key1", "val1", "key2", "val2").alias("env"))
    instances = fx("fx_env_inst").select(
        "instance_id", "cluster_id", "container", F.create_map("name1", "env1", "name2", "env2").alias("container_env"))
    return env_drift(instances, specs, KEY, ("instance_id",))


@query("extend_ip_drift", """
WITH j AS (SELECT e.*, n.networks FROM fx_ext e JOIN fx_net n USING (cluster_id) WHERE n.network_class = 'kube-ovn' AND extend_ip <> '')
SELECT cluster_id, ip, CASE WHEN networks IS NULL THEN 'no_network_annotation'
       WHEN note_key <> 'net1.ns1.ovn.kubernetes.io/ip_address' THEN 'no_address_annotation' ELSE 'other_address' END AS reason
FROM j
WHERE networks IS NULL OR (networks LIKE '[{%' AND (note_key <> 'net1.ns1.ovn.kubernetes.io/ip_address' OR note_value <> extend_ip))
""")
def _(fx):
    return extend_ip_drift(*extend_ip_inputs(fx), KEY)


def extend_ip_inputs(fx):
    ext = fx("fx_ext")
    instances = ext.select("cluster_id", "ip", F.create_map("note_key", "note_value").alias("annotations"))
    networks = F.create_map(F.lit("k8s.v1.cni.cncf.io/networks"), F.col("networks"))
    clusters = fx("fx_net").select(
        "cluster_id", "network_class",
        F.when(F.col("networks").isNotNull(), networks).otherwise(F.create_map().cast("map<string,string>")).alias("spec_annotations"))
    return ext.select("cluster_id", "ip", "extend_ip"), instances, clusters


@query("extend_ip_rollup", """
SELECT e.cluster_id, count(*) AS checked, count(d.reason) AS faulty, count(*) FILTER (WHERE d.reason = 'no_network_annotation') AS no_network_annotation,
       count(*) FILTER (WHERE d.reason = 'no_address_annotation') AS no_address_annotation, count(*) FILTER (WHERE d.reason = 'other_address') AS other_address
FROM fx_ext e JOIN fx_net n USING (cluster_id) LEFT JOIN q_extend_ip_drift d ON d.cluster_id = e.cluster_id AND d.ip = e.ip
WHERE n.network_class = 'kube-ovn' AND e.extend_ip <> '' GROUP BY 1
""")
def _(fx):
    return extend_ip_rollup(*extend_ip_inputs(fx), KEY)


@query("bandwidth_annotations", """
WITH w AS (SELECT * FROM fx_bandwidth WHERE coalesce(bandwidth, '') <> '')
SELECT cluster_id, a AS annotation, CASE WHEN network_class <> 'kube-ovn' THEN bandwidth
       WHEN cluster_id % 5 = 1 THEN CAST(size + 1 AS VARCHAR) WHEN cluster_id % 5 = 2 THEN CAST(size * 1000 AS VARCHAR)
       ELSE CAST(CAST(ceil(CAST(concat('0.', size) AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR) END AS value
FROM (SELECT *, unnest(CASE WHEN network_class = 'kube-ovn' THEN ['ovn.kubernetes.io/ingress_rate', 'ovn.kubernetes.io/egress_rate']
      ELSE ['kubernetes.io/ingress-bandwidth', 'kubernetes.io/egress-bandwidth'] END) AS a FROM w) u
""")
def _(fx):
    return bandwidth_annotations(fx("fx_bandwidth"), KEY)


@query("restart_required", """
SELECT cluster_id, count(*) AS changed, bool_or(prop = 'max_connections') AS restart
FROM fx_config WHERE curr_value IS NOT NULL AND curr_value IS DISTINCT FROM prev_value GROUP BY 1
""")
def _(fx):
    changed = fx("fx_config").where("curr_value IS NOT NULL AND NOT curr_value <=> prev_value")
    return restart_required(changed, KEY, "prop")


@query("mount_failures", """
SELECT cluster_id, slot FROM ox_latest WHERE phase = 'Pending' AND EXISTS (
  SELECT 1 FROM fx_probe e WHERE e.cluster_id = ox_latest.cluster_id AND e.slot = ox_latest.slot AND e.k2 % 4 < 2)
""")
def _(fx):
    pending = probes(fx, "phase").where("phase = 'Pending'").select("cluster_id", "slot")
    return mount_failures(pending, fx("fx_mount_event"), ["cluster_id", "slot"])


@query("mount_wait_exemption", """
WITH m AS (
  SELECT m.cluster_id, coalesce(bool_or(p.phase = 'Running' AND p.port_open), false) AS run,
         coalesce(bool_or(p.phase = 'Pending' AND p.k1 % 1000 > 300 AND EXISTS (
           SELECT 1 FROM fx_probe e WHERE e.cluster_id = p.cluster_id AND e.ip = p.ip AND e.k2 % 4 < 2)), false) AS bad
  FROM fx_member m LEFT JOIN ox_latest p USING (cluster_id, ip) GROUP BY m.cluster_id, m.ip
), c AS (
  SELECT cluster_id, count(*) AS desired, count(*) FILTER (WHERE run) AS running, count(*) FILTER (WHERE bad AND NOT run) AS exempt
  FROM m GROUP BY 1
)
SELECT *, CASE WHEN running = desired THEN 'complete' WHEN running = 0 AND exempt = desired THEN 'all_failed'
       WHEN running > 0 AND running + exempt = desired THEN 'form_without_failed' ELSE 'wait' END AS verdict FROM c
""")
def _(fx):
    instances = probes(fx, "ip", "phase", "port_open").select(
        "cluster_id", "ip", "phase", ((F.col("phase") == "Running") & F.col("port_open")).alias("ready"),
        (F.col("k1") % 1000).alias("age_s"))
    events = fx("fx_probe").select(
        "cluster_id", "ip", F.when(F.col("k2") % 4 == 0, "FailedMount").when(F.col("k2") % 4 == 1, "FailedAttachVolume")
        .otherwise("Pulled").alias("reason"))
    return mount_wait_exemption(fx("fx_member"), instances, events, KEY, 300)


view("ox_peer", """
SELECT cluster_id, ip, slot AS ord FROM fx_member
UNION ALL SELECT r.cluster_id, r.ip, c.want_slots + r.slot FROM fx_remote r JOIN fx_cluster c USING (cluster_id)
""")
view("ox_edge", """
SELECT m.cluster_id, m.ip, p.ip AS remote_ip, row_number() OVER (PARTITION BY m.cluster_id, m.ip ORDER BY p.ord) AS slot
FROM fx_member m JOIN ox_peer p ON p.cluster_id = m.cluster_id AND p.ip <> m.ip
UNION ALL
SELECT cluster_id, ip, '127.0.0.1', 1 FROM fx_member JOIN fx_cluster USING (cluster_id) WHERE want_slots = 1 AND remote_count = 0
""")


@query("replication_edges", """
SELECT m.cluster_id, m.ip, CASE WHEN e.remote_ip = '127.0.0.1' THEN e.remote_ip ELSE m.ip END AS local_ip, g.s AS slot,
       c.want_slots + c.remote_count - 1 AS edges, greatest(c.want_slots + c.remote_count - 8, 0) AS beyond,
       coalesce(e.remote_ip, '') AS remote_ip,
       CASE WHEN e.slot IS NULL THEN 0 ELSE 5433 END AS data_port, CASE WHEN e.slot IS NULL THEN 0 ELSE 5436 END AS service_port,
       CASE WHEN e.slot IS NULL THEN 0 ELSE 5437 END AS heartbeat_port
FROM fx_member m JOIN fx_cluster c USING (cluster_id) JOIN generate_series(1, 7) g(s) ON true
LEFT JOIN ox_edge e ON e.cluster_id = m.cluster_id AND e.ip = m.ip AND e.slot = g.s
""")
def _(fx):
    members = fx("fx_member").withColumnRenamed("slot", "pos")
    remotes = fx("fx_remote").withColumnRenamed("slot", "pos")
    return replication_edges(members, remotes, KEY, 5432)


@query("replication_topology", """
SELECT cluster_id, ip, ord AS ordinal, 5433 AS data_port, 5436 AS service_port, 5437 AS heartbeat_port FROM ox_peer
""")
def _(fx):
    members = fx("fx_member").withColumnRenamed("slot", "pos")
    remotes = fx("fx_remote").withColumnRenamed("slot", "pos")
    return topology(members, remotes, KEY, 5432)


view("fx_edge_seen", """
SELECT cluster_id, ip, concat('10.', CAST(cluster_id % 3 AS STRING), '.', CAST((k2 % 6 * 37) % 11 AS STRING), '.', CAST(k2 % 6 AS STRING)) AS remote_ip
FROM fx_probe WHERE k1 % 3 > 0
UNION ALL SELECT cluster_id, ip, concat('10.8.', CAST(cluster_id % 200 AS STRING), '.1') FROM fx_probe WHERE k1 % 3 = 0
UNION ALL SELECT cluster_id, ip, '127.0.0.1' FROM fx_probe WHERE k1 % 7 = 0
""")


@query("edge_drift", """
WITH o AS (SELECT DISTINCT cluster_id, ip, remote_ip FROM fx_edge_seen),
k AS (
  SELECT cluster_id, ip, count(*) FILTER (WHERE good) AS r, count(*) FILTER (WHERE NOT good) AS u FROM (
    SELECT o.*, EXISTS (SELECT 1 FROM ox_edge e WHERE e.cluster_id = o.cluster_id AND e.ip = o.ip AND e.remote_ip = o.remote_ip) AS good
    FROM o) t GROUP BY 1, 2
)
SELECT m.cluster_id, m.ip, coalesce(r, 0) AS "right", coalesce(u, 0) AS unexpected,
       greatest(c.want_slots + c.remote_count - 1, 1) - coalesce(r, 0) AS missing
FROM fx_member m JOIN fx_cluster c USING (cluster_id) LEFT JOIN k ON k.cluster_id = m.cluster_id AND k.ip = m.ip
""")
def _(fx):
    members = fx("fx_member").withColumnRenamed("slot", "pos")
    remotes = fx("fx_remote").withColumnRenamed("slot", "pos")
    return edge_drift(members, remotes, fx("fx_edge_seen"), KEY)


@query("acl_drift", """
WITH o AS (
  SELECT DISTINCT cluster_id, ip, concat('host all all ', remote_ip, '/32 trust') AS rule FROM fx_edge_seen
  UNION SELECT cluster_id, ip, 'host all all 0.0.0.0/0 md5' FROM fx_edge_seen
), w AS (
  SELECT DISTINCT cluster_id, concat('host all all ', ip, '/32 trust') AS rule FROM ox_peer
  UNION SELECT cluster_id, r FROM fx_cluster, (VALUES ('host all all 0.0.0.0/0 md5'), ('host replication backupuser 0.0.0.0/0 md5')) v(r)
), k AS (
  SELECT o.cluster_id, o.ip, count(w.rule) AS held, count(*) - count(w.rule) AS unexpected
  FROM o LEFT JOIN w ON w.cluster_id = o.cluster_id AND w.rule = o.rule GROUP BY 1, 2
)
SELECT m.cluster_id, m.ip, coalesce(held, 0) AS held, coalesce(unexpected, 0) AS unexpected,
       c.want_slots + c.remote_count + 2 - coalesce(held, 0) AS missing
FROM fx_member m JOIN fx_cluster c USING (cluster_id) LEFT JOIN k ON k.cluster_id = m.cluster_id AND k.ip = m.ip
""")
def _(fx):
    members = fx("fx_member").withColumnRenamed("slot", "pos")
    remotes = fx("fx_remote").withColumnRenamed("slot", "pos")
    seen = fx("fx_edge_seen")
    observed = seen.select("cluster_id", "ip", F.concat(F.lit("host all all "), "remote_ip", F.lit("/32 trust")).alias("rule"))
    observed = observed.union(seen.select("cluster_id", "ip", F.lit("host all all 0.0.0.0/0 md5")))
    return acl_drift(members, remotes, observed, KEY)


@query("sync_policy", """
WITH n AS (
  SELECT m.cluster_id, m.ip, c.want_slots, c.remote_count, c.cluster_id % 6 AS applied,
         string_agg(concat('og_', replace(p.ip, '.', '_')), ',' ORDER BY p.ord) AS names
  FROM fx_member m JOIN fx_cluster c USING (cluster_id)
  LEFT JOIN ox_peer p ON p.cluster_id = m.cluster_id AND p.ip <> m.ip GROUP BY ALL
)
SELECT cluster_id, ip,
       CASE WHEN want_slots = 1 AND remote_count = 0 THEN ''
            ELSE concat('FIRST ', CASE WHEN remote_count > 0 THEN want_slots ELSE want_slots // 2 END, '(', names, ')') END AS standby_names,
       CASE WHEN (want_slots > 1 OR remote_count > 0) AND (applied > 1 OR remote_count > 0) THEN 'OFF' ELSE 'ON' END AS most_available
FROM n
""")
def _(fx):
    def ip(slot):
        return F.concat(
            F.lit("10."), (F.col("cluster_id") % 3).cast("string"), F.lit("."), ((slot * 37) % 11).cast("string"),
            F.lit("."), slot.cast("string"))

    local = F.transform(F.sequence(F.lit(1), "want_slots"), ip)
    remote = F.when(F.col("remote_count") > 0, F.transform(
        F.sequence(F.lit(1), F.col("remote_count")),
        lambda s: F.concat(F.lit("10.8."), (F.col("cluster_id") % 200).cast("string"), F.lit("."), s.cast("string"))))
    return sync_policy(fx("fx_cluster"), KEY, local, remote, F.col("cluster_id") % 6, F.col("remote_count"))


@query("capacity_drift", """
WITH p AS (
  SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_partkey % 3 - 1 AS d, p_partkey % 5 AS u, p_partkey % 10 AS t FROM part
), v AS (
  SELECT *, CASE u WHEN 0 THEN p_size * 1073741824 WHEN 1 THEN p_size * 1000000000 WHEN 2 THEN p_size * 1048576 END AS big,
         CASE u WHEN 3 THEN p_size END AS milli FROM p
), s AS (
  SELECT *, CASE WHEN u < 3 THEN CAST(big AS DECIMAL(38,3)) WHEN u = 3 THEN CAST(milli AS DECIMAL(38,3)) / 1000 END AS amt FROM v
)
SELECT q.cluster_id, q.desired, q.actual, CAST(amt AS DECIMAL(38,3)) AS desired_amount,
       CASE WHEN u = 4 THEN CASE WHEN p_size + d > 0 THEN 'shrink' WHEN p_size + d < 0 THEN 'expand' ELSE 'equal' END
            WHEN d < 0 THEN 'expand' WHEN d > 0 THEN 'shrink' ELSE 'equal' END AS change,
       u < 4 AND d <> 0 AS needs_resize
FROM s JOIN fx_quantity q ON q.cluster_id = p_partkey
""")
def _(fx):
    return capacity_drift(fx("fx_quantity"), KEY, "desired", "actual")
