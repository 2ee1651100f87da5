"""Spec checks, defaults, differences and the action they call for."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.change import (
    config_delta, config_effective, plan_action, spec_change_flags, spec_diff,
)
from ..operators.defaults import apply_defaults
from ..operators.validation import validate_specs, verdicts, with_violations
from ..plans.reconcile import decide
from ..sources.schemas import SPEC_FIELDS
from .common import KEY
from .health import health_of
from .registry import query, view


def _empty_map():
    return F.create_map().cast("map<string,string>")


def _pair(key, value):
    """Map of one entry, empty when the key is blank."""
    return F.when(key != "", F.create_map(key, value)).otherwise(_empty_map())


def spec_struct(**values):
    """Struct of the declared spec type; fields not given are NULL."""
    fields = StructType.fromDDL(SPEC_FIELDS).fields
    return F.struct(*[
        (values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields
    ])


def specs(fx):
    c = F.col
    members = F.transform(
        F.when(c("d_members") > 0, F.sequence(F.lit(1), c("d_members"))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.when(i == 1, c("d_ip1")).otherwise(F.concat(F.lit("10.1.0."), i.cast("string"))).alias("ip"),
            F.concat(F.lit("node"), i.cast("string")).alias("node_name"),
            F.when(i == 1, c("d_ext1")).otherwise("").alias("extend_ip")))
    applied_members = F.transform(
        F.sequence(F.lit(1), F.lit(2)),
        lambda i: F.struct(
            F.concat(F.lit("10.1.0."), i.cast("string")).alias("ip"),
            F.concat(F.lit("node"), i.cast("string")).alias("node_name"), F.lit("").alias("extend_ip")))
    notes = F.map_filter(
        F.create_map(
            F.lit("attach_logical_switch_array"), c("d_subnets"), F.lit("k8s.v1.cni.cncf.io/networks"), c("d_networks"),
            F.lit("ovn.kubernetes.io/logical_switch"), F.when(c("d_has_switch"), "sw").otherwise("")),
        lambda _k, v: v != "")
    nodes = F.when(c("d_nodes") == 1, F.array(F.lit("n1"))).otherwise(F.array().cast("array<string>"))
    labels = F.when(c("d_nodes") == 2, F.create_map(F.lit("zone"), F.lit("a"))).otherwise(_empty_map())

    def schedule(timeout, liveness, nodes, node_labels):
        return F.struct(
            timeout.alias("process_timeout"), F.lit(30).alias("grace_period"), F.lit(300).alias("toleration"),
            F.lit(60).alias("most_available_timeout"), nodes.alias("nodes"), F.lit(60).cast("bigint").alias("polling_period"),
            liveness.alias("liveness_period"), F.lit(30).alias("readiness_period"), node_labels.alias("node_labels"))

    desired = spec_struct(
        image=c("d_image"), db_port=c("d_db_port"), secret_fingerprint=c("d_secret"), hostpath_root=c("d_hostpath"),
        storage_class=c("d_storage_class"), network_class=c("d_network"), local_role=c("d_role"), read_port=c("d_read_port"),
        write_port=c("d_write_port"), cpu=c("d_cpu"), memory=c("d_memory"), storage=c("d_storage"),
        bandwidth=c("d_bandwidth"), sidecar_cpu=c("d_side_cpu"), sidecar_memory=c("d_side_memory"),
        sidecar_storage=c("d_side_storage"), backup_path=c("d_backup_path"), archive_log_path=c("d_archive_path"),
        ip_list=members, remote_ip_list=F.when(c("d_remotes") > 0, F.array(c("d_remote1"))).otherwise(F.array().cast("array<string>")),
        config=_pair(c("d_config_key"), F.lit("64")), customized_env=_pair(c("d_env_key"), F.lit("1")), annotations=notes,
        maintenance=c("d_maintenance"), restore_file=c("d_restore"), script_config=F.lit("script"), filebeat_config=F.lit("logs"),
        schedule=schedule(c("d_timeout"), c("d_liveness"), nodes, labels))
    applied = spec_struct(
        image=c("a_image"), db_port=F.lit(5432), secret_fingerprint=F.lit("f1"), hostpath_root=F.lit(""),
        storage_class=F.lit("fast"), network_class=c("a_network"), local_role=F.lit("primary"), read_port=c("a_read_port"),
        write_port=(F.lit(31000) + c("cluster_id") % 1000), cpu=F.lit("2"), memory=F.lit("4Gi"), storage=c("a_storage"),
        bandwidth=F.lit(""), sidecar_cpu=F.lit("0.5"), sidecar_memory=F.lit("500Mi"), sidecar_storage=F.lit("2Gi"),
        backup_path=F.lit("/backup"), archive_log_path=F.lit("/arch"), ip_list=applied_members,
        remote_ip_list=F.array().cast("array<string>"), config=_pair(c("a_config_key"), F.lit("64")),
        customized_env=_pair(F.lit("OG_MODE"), F.lit("1")), annotations=_empty_map(), maintenance=c("a_maintenance"),
        restore_file=F.lit(""), script_config=F.lit("script"), filebeat_config=F.lit("logs"),
        schedule=schedule(F.lit(300), F.lit(30), F.array().cast("array<string>"), _empty_map()))
    # wanted and applied specs are two tables of the fleet; a rule reads fields of both
    wanted = fx("fx_spec").select("cluster_id", desired.alias("desired"))
    return wanted.join(fx("fx_spec").select("cluster_id", applied.alias("applied")), KEY)


view("ox_rule", """
SELECT s.*, a_image = '' AS fresh, d_network = 'kube-ovn' AS ovn, c.state AS cluster_state FROM fx_spec s JOIN fx_cluster c USING (cluster_id)
""")
view("ox_violation", """
SELECT cluster_id, 'V01' AS rule, 'image' AS field, '' AS value FROM ox_rule WHERE d_image = ''
UNION ALL SELECT cluster_id, 'V02', 'db_port', CAST(d_db_port AS VARCHAR) FROM ox_rule WHERE NOT fresh AND d_db_port <> 5432
UNION ALL SELECT cluster_id, 'V03', 'secret_fingerprint', d_secret FROM ox_rule WHERE NOT fresh AND d_secret <> 'f1'
UNION ALL SELECT cluster_id, 'V04', 'hostpath_root', d_hostpath FROM ox_rule WHERE NOT fresh AND d_hostpath <> ''
UNION ALL SELECT cluster_id, 'V05', 'storage_class', d_storage_class FROM ox_rule WHERE NOT fresh AND d_storage_class <> 'fast'
UNION ALL SELECT cluster_id, 'V06', 'network_class', d_network FROM ox_rule WHERE NOT fresh AND a_network <> '' AND d_network <> a_network
UNION ALL SELECT cluster_id, 'V07', 'local_role', d_role FROM ox_rule WHERE d_role = 'leader'
UNION ALL SELECT cluster_id, 'V08', 'read_port', CAST(d_read_port AS VARCHAR) FROM ox_rule WHERE d_read_port < 30000 OR d_read_port > 32767
UNION ALL SELECT cluster_id, 'V09', 'write_port', CAST(d_write_port AS VARCHAR) FROM ox_rule WHERE d_write_port < 30000 OR d_write_port > 32767
UNION ALL SELECT cluster_id, 'V10', 'cpu', d_cpu FROM ox_rule WHERE d_cpu = 'two'
UNION ALL SELECT cluster_id, 'V11', 'cpu', d_cpu FROM ox_rule WHERE d_cpu = '400m'
UNION ALL SELECT cluster_id, 'V12', 'memory', d_memory FROM ox_rule WHERE d_memory = '4 Gi'
UNION ALL SELECT cluster_id, 'V13', 'memory', d_memory FROM ox_rule WHERE d_memory = '1Gi'
UNION ALL SELECT cluster_id, 'V14', 'storage', d_storage FROM ox_rule WHERE d_storage = 'big'
UNION ALL SELECT cluster_id, 'V15', 'storage', d_storage FROM ox_rule WHERE d_storage = '2Gi'
UNION ALL SELECT cluster_id, 'V16', 'storage', d_storage FROM ox_rule WHERE NOT fresh AND d_storage = '5Gi' AND a_storage = '10Gi'
UNION ALL SELECT cluster_id, 'V17', 'bandwidth', d_bandwidth FROM ox_rule WHERE d_bandwidth = '2X'
UNION ALL SELECT cluster_id, 'V18', 'sidecar_cpu', d_side_cpu FROM ox_rule WHERE d_side_cpu = '-'
UNION ALL SELECT cluster_id, 'V19', 'sidecar_cpu', d_side_cpu FROM ox_rule WHERE d_side_cpu = '100m'
UNION ALL SELECT cluster_id, 'V20', 'sidecar_memory', d_side_memory FROM ox_rule WHERE d_side_memory = '1Gig'
UNION ALL SELECT cluster_id, 'V21', 'sidecar_memory', d_side_memory FROM ox_rule WHERE d_side_memory = '499Mi'
UNION ALL SELECT cluster_id, 'V22', 'sidecar_storage', d_side_storage FROM ox_rule WHERE d_side_storage = '1GB'
UNION ALL SELECT cluster_id, 'V23', 'sidecar_storage', d_side_storage FROM ox_rule WHERE d_side_storage = '1000Mi'
UNION ALL SELECT cluster_id, 'V24', 'sidecar_storage', d_side_storage FROM ox_rule WHERE NOT fresh AND d_side_storage = '1.5Gi'
UNION ALL SELECT cluster_id, 'V25', 'hostpath_root', d_hostpath FROM ox_rule WHERE d_hostpath <> '' AND d_storage_class <> ''
UNION ALL SELECT cluster_id, 'V26', 'network_class', d_network FROM ox_rule WHERE fresh AND d_network NOT IN ('calico', 'kube-ovn')
UNION ALL SELECT cluster_id, 'V27', 'annotations', '' FROM ox_rule WHERE fresh AND ovn AND NOT d_has_switch
UNION ALL SELECT cluster_id, 'V28', 'hostpath_root', d_hostpath FROM ox_rule WHERE d_hostpath <> '' AND NOT starts_with(d_hostpath, '/')
UNION ALL SELECT cluster_id, 'V29', 'backup_path', d_backup_path FROM ox_rule WHERE d_backup_path = 'backup'
UNION ALL SELECT cluster_id, 'V30', 'archive_log_path', d_archive_path FROM ox_rule WHERE d_archive_path = 'arch'
UNION ALL SELECT cluster_id, 'V31', 'ip_list', '' FROM ox_rule WHERE d_members = 0
UNION ALL SELECT cluster_id, 'V32', 'ip_list', d_ip1 FROM ox_rule WHERE d_members > 0 AND d_ip1 IN ('127.0.0.1', '10.0.0.300')
UNION ALL SELECT cluster_id, 'V33', 'extend_ip', d_ext1 FROM ox_rule WHERE d_members > 0 AND ovn AND d_ext1 <> ''
  AND (d_ext1 = 'bad' OR NOT (d_subnets LIKE '[{%' AND d_networks LIKE '[{%'))
UNION ALL SELECT cluster_id, 'V34', 'extend_ip', d_ext1 FROM ox_rule WHERE d_members > 0 AND d_network = 'calico' AND d_ext1 <> ''
UNION ALL SELECT cluster_id, 'V35', 'remote_ip_list', d_remote1 FROM ox_rule WHERE d_remotes > 0 AND d_remote1 = '224.0.0.1'
UNION ALL SELECT cluster_id, 'V36', 'remote_ip_list', '' FROM ox_rule WHERE d_role = 'standby' AND d_remotes = 0
UNION ALL SELECT cluster_id, 'V37', 'config', d_config_key FROM ox_rule WHERE NOT fresh AND d_config_key = 'wal_block_size'
UNION ALL SELECT cluster_id, 'V38', 'customized_env', d_env_key FROM ox_rule WHERE d_env_key IN ('MONITOR', 'og_MY_POD_IP')
UNION ALL SELECT cluster_id, 'V39', 'schedule', '' FROM ox_rule WHERE NOT ovn AND d_nodes IN (1, 2)
""")


@query("validate_specs", "SELECT * FROM ox_violation")
def _(fx):
    return validate_specs(specs(fx), KEY)


@query("error_rollup", """
WITH v AS (
  SELECT cluster_id, count(*) AS n, string_agg(concat(rule, ' ', field, '=', value), chr(10) ORDER BY rule) AS lines
  FROM ox_violation GROUP BY 1
)
SELECT r.cluster_id, coalesce(n, 0) AS violation_count,
       CASE WHEN n IS NULL THEN 'valid' WHEN fresh THEN 'stop' ELSE 'keep_last_valid' END AS verdict,
       CASE WHEN n IS NULL THEN '' ELSE concat('spec check failed: ', lines) END AS message
FROM ox_rule r LEFT JOIN v ON v.cluster_id = r.cluster_id
""")
def _(fx):
    return verdicts(with_violations(specs(fx)), KEY)


@query("apply_defaults", """
SELECT cluster_id, CASE WHEN d_role = '' THEN 'primary' ELSE d_role END AS local_role,
  CASE WHEN d_db_port = 0 THEN 5432 ELSE d_db_port END AS db_port,
  CASE WHEN d_cpu = '' THEN '1' ELSE d_cpu END AS cpu, CASE WHEN d_memory = '' THEN '4Gi' ELSE d_memory END AS memory,
  CASE WHEN d_storage <> '' THEN d_storage WHEN NOT fresh AND a_storage <> '' THEN a_storage ELSE '3Gi' END AS storage,
  CASE WHEN d_side_cpu = '' THEN '500m' ELSE d_side_cpu END AS sidecar_cpu,
  CASE WHEN d_side_memory = '' THEN '1Gi' ELSE d_side_memory END AS sidecar_memory,
  CASE WHEN d_side_storage <> '' THEN d_side_storage WHEN NOT fresh THEN '2Gi' ELSE '1Gi' END AS sidecar_storage,
  CASE WHEN d_backup_path = '' THEN '/data/k8slocalxbk' ELSE d_backup_path END AS backup_path,
  CASE WHEN d_archive_path = '' THEN '/data/k8slocalogarchive' ELSE d_archive_path END AS archive_log_path,
  CASE WHEN d_hostpath = '' AND d_storage_class = '' THEN 'topolvm-provisioner' ELSE d_storage_class END AS storage_class,
  CASE WHEN NOT fresh AND d_network = '' THEN 'calico' ELSE d_network END AS network_class,
  CASE WHEN d_timeout = 0 THEN 300 ELSE d_timeout END AS process_timeout,
  CASE WHEN d_liveness = 0 THEN 30 ELSE d_liveness END AS liveness_period,
  CASE WHEN d_env_key = '' THEN 'og_MONITOR_TYPE=DATABASE' ELSE concat(d_env_key, '=1') END AS env,
  CASE WHEN d_config_key = '' THEN '' WHEN a_config_key = d_config_key THEN concat(d_config_key, '=64')
       ELSE concat(least(a_config_key, d_config_key), '=64,', greatest(a_config_key, d_config_key), '=64') END AS config,
  d_role = '' OR d_db_port = 0 OR d_cpu = '' OR d_memory = '' OR d_storage = '' OR d_side_cpu = '' OR d_side_memory = ''
    OR d_side_storage = '' OR d_backup_path = '' OR d_archive_path = '' OR (d_hostpath = '' AND d_storage_class = '')
    OR (NOT fresh AND d_network = '') OR d_timeout = 0 OR d_liveness = 0 OR d_env_key = ''
    OR (d_config_key <> '' AND d_config_key <> a_config_key) AS updated
FROM ox_rule
""")
def _(fx):
    filled = apply_defaults(specs(fx))
    d = F.col("desired")

    def text(m):
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")

    plain = ["local_role", "db_port", "cpu", "memory", "storage", "sidecar_cpu", "sidecar_memory", "sidecar_storage",
             "backup_path", "archive_log_path", "storage_class", "network_class"]
    return filled.select(
        "cluster_id", *[d[n].alias(n) for n in plain], d["schedule"]["process_timeout"].alias("process_timeout"),
        d["schedule"]["liveness_period"].alias("liveness_period"), text(d["customized_env"]).alias("env"),
        text(d["config"]).alias("config"), "updated")


view("ox_diff", """
SELECT cluster_id, 'container' AS class, 'image' AS field, a_image AS old_value, d_image AS new_value FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'cpu', '2', d_cpu FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'memory', '4Gi', d_memory FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'bandwidth', '', d_bandwidth FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'sidecar_cpu', '0.5', d_side_cpu FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'sidecar_memory', '500Mi', d_side_memory FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'backup_path', '/backup', d_backup_path FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'archive_log_path', '/arch', d_archive_path FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'container', 'customized_env', 'OG_MODE=1', CASE WHEN d_env_key = '' THEN '' ELSE concat(d_env_key, '=1') END FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, k, 'liveness_period', '30', CAST(d_liveness AS VARCHAR) FROM ox_rule, (VALUES ('container'), ('schedule')) t(k) WHERE NOT fresh
UNION ALL SELECT cluster_id, 'schedule', 'process_timeout', '300', CAST(d_timeout AS VARCHAR) FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'schedule', 'node_labels', '', CASE WHEN d_nodes = 2 THEN 'zone=a' ELSE '' END FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'storage', 'storage', a_storage, d_storage FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'storage', 'sidecar_storage', '2Gi', d_side_storage FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'service', 'read_port', CAST(a_read_port AS VARCHAR), CAST(d_read_port AS VARCHAR) FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'service', 'write_port', CAST(31000 + cluster_id % 1000 AS VARCHAR), CAST(d_write_port AS VARCHAR) FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'role', 'local_role', 'primary', d_role FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'restore', 'restore_file', '', d_restore FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'maintenance', 'maintenance', CAST(a_maintenance AS VARCHAR), CAST(d_maintenance AS VARCHAR) FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'config', 'config', concat(a_config_key, '=64'), CASE WHEN d_config_key = '' THEN '' ELSE concat(d_config_key, '=64') END FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'annotation', 'annotations', '', concat_ws(',',
    CASE WHEN d_subnets <> '' THEN concat('attach_logical_switch_array=', d_subnets) END,
    CASE WHEN d_networks <> '' THEN concat('k8s.v1.cni.cncf.io/networks=', d_networks) END,
    CASE WHEN d_has_switch THEN 'ovn.kubernetes.io/logical_switch=sw' END) FROM ox_rule WHERE NOT fresh
UNION ALL SELECT cluster_id, 'members', 'ip_list', '2:10.1.0.1,10.1.0.2', concat(d_members, ':', array_to_string(list_sort(m), ',')) FROM ox_members WHERE NOT fresh
UNION ALL SELECT cluster_id, 'entries', 'ip_list', '2:10.1.0.1|node1|,10.1.0.2|node2|', concat(d_members, ':', array_to_string(list_sort(e), ',')) FROM ox_members WHERE NOT fresh
UNION ALL SELECT cluster_id, 'remote', 'remote_ip_list', '0:', CASE WHEN d_remotes > 0 THEN concat('1:', d_remote1) ELSE '0:' END FROM ox_rule WHERE NOT fresh
""")
view("ox_members", """
SELECT *, CASE WHEN d_members = 0 THEN [] ELSE list_concat([d_ip1], ['10.1.0.2', '10.1.0.3'][1:d_members - 1]) END AS m,
  CASE WHEN d_members = 0 THEN [] ELSE list_concat([concat(d_ip1, '|node1|', d_ext1)], ['10.1.0.2|node2|', '10.1.0.3|node3|'][1:d_members - 1]) END AS e
FROM ox_rule
""")


@query("spec_diff", "SELECT * FROM ox_diff WHERE old_value <> new_value")
def _(fx):
    return spec_diff(specs(fx), KEY)


_CLASSES = ["container", "storage", "service", "members", "entries", "remote", "config", "annotation", "label", "role",
            "restore", "maintenance", "schedule"]
_RESOURCE = "('container', 'storage', 'service', 'entries', 'annotation', 'label')"


@query("spec_change_flags", f"""
WITH d AS (SELECT cluster_id, class FROM ox_diff WHERE old_value <> new_value)
SELECT r.cluster_id, r.fresh AS is_new,
  {', '.join(f"coalesce(bool_or(d.class = '{c}'), false) AS {c}_changed" for c in _CLASSES)},
  coalesce(bool_or(d.class IN {_RESOURCE}), false) AS resource_changed,
  r.fresh OR coalesce(bool_or(d.class NOT IN ('members', 'maintenance')), false) AS changed
FROM ox_rule r LEFT JOIN d ON d.cluster_id = r.cluster_id GROUP BY r.cluster_id, r.fresh
""")
def _(fx):
    return spec_change_flags(specs(fx), KEY)


@query("config_delta", """
SELECT cluster_id, prop, curr_value AS value FROM fx_config WHERE curr_value IS NOT NULL AND curr_value IS DISTINCT FROM prev_value
""")
def _(fx):
    return config_delta(fx("fx_config"), KEY)


@query("config_effective", """
SELECT cluster_id, prop, coalesce(curr_value, prev_value) AS value FROM fx_config
WHERE coalesce(curr_value, prev_value) IS NOT NULL
  AND cluster_id IN (SELECT cluster_id FROM fx_config WHERE curr_value IS NOT NULL)
""")
def _(fx):
    return config_effective(fx("fx_config"), KEY)


view("ox_action", """
WITH s AS (
  SELECT f.*, c.state, r.d_maintenance AND r.a_maintenance AS in_maint, h.needs_reconcile
  FROM q_spec_change_flags f JOIN fx_cluster c USING (cluster_id) JOIN ox_rule r USING (cluster_id)
  JOIN q_cluster_health h USING (cluster_id)
)
SELECT *, CASE WHEN is_new THEN 'create' WHEN maintenance_changed THEN 'switch_maintenance' WHEN in_maint THEN 'skip'
  WHEN changed AND restore_changed THEN 'restore' WHEN changed THEN 'update' WHEN state NOT IN ('ready', 'invalid') THEN 'continue'
  WHEN needs_reconcile THEN 'recover' ELSE 'idle' END AS action FROM s
""")


@query("plan_action", """
SELECT cluster_id, action,
  CASE action WHEN 'create' THEN 'creating' WHEN 'restore' THEN 'restoring' WHEN 'update' THEN 'updating'
       WHEN 'recover' THEN CASE WHEN state = 'invalid' THEN state ELSE 'recovering' END ELSE state END AS next_state,
  CASE WHEN action = 'create' THEN 'resource,instances,service' WHEN action IN ('restore', 'update') THEN concat_ws(',',
    CASE WHEN resource_changed THEN 'resource' END,
    CASE WHEN resource_changed OR config_changed OR remote_changed OR role_changed THEN 'instances' END,
    CASE WHEN role_changed THEN 'service' END) ELSE '' END AS resets
FROM ox_action
""")
def _(fx):
    rows = specs(fx)
    modes = rows.select("cluster_id", (F.col("desired")["maintenance"] & F.col("applied")["maintenance"]).alias("in_maintenance"))
    states = (
        spec_change_flags(rows, KEY).join(modes, KEY)
        .join(fx("fx_cluster").select("cluster_id", "state"), KEY)
        .join(health_of(fx).select("cluster_id", "needs_reconcile"), KEY)
    )
    return plan_action(states, KEY)


@query("reconcile_decisions", """
WITH bad AS (SELECT DISTINCT cluster_id FROM ox_violation),
d AS (SELECT *, 'x' AS s FROM q_apply_defaults),
e AS (
  SELECT r.cluster_id, r.fresh, b.cluster_id IS NOT NULL AS bad, r.d_maintenance, r.a_maintenance, CASE WHEN c.state = 'invalid' THEN 'ready' ELSE c.state END AS state, h.needs_reconcile,
    -- fields that defaults can bring back to the applied value
    r.d_image <> r.a_image OR d.cpu <> '2' OR d.memory <> '4Gi' OR r.d_bandwidth <> '' OR d.sidecar_cpu <> '0.5'
      OR d.sidecar_memory <> '500Mi' OR d.backup_path <> '/backup' OR d.archive_log_path <> '/arch' OR d.env <> 'OG_MODE=1'
      OR d.liveness_period <> 30 OR d.storage <> r.a_storage OR d.sidecar_storage <> '2Gi' OR r.d_read_port <> r.a_read_port
      OR r.d_write_port <> 31000 + r.cluster_id % 1000
      OR concat(r.d_members, ':', array_to_string(list_sort(m.e), ',')) <> '2:10.1.0.1|node1|,10.1.0.2|node2|'
      OR r.d_subnets <> '' OR r.d_networks <> '' OR r.d_has_switch AS res,
    d.config <> concat(r.a_config_key, '=64') AS cfg, r.d_remotes > 0 AS rem, d.local_role <> 'primary' AS rol,
    r.d_restore <> '' AS rst, d.liveness_period <> 30 OR d.process_timeout <> 300 OR r.d_nodes = 2 AS sch
  FROM ox_rule r JOIN d USING (cluster_id) JOIN ox_members m USING (cluster_id) JOIN fx_cluster c ON c.cluster_id = r.cluster_id
  JOIN q_cluster_health h ON h.cluster_id = r.cluster_id LEFT JOIN bad b ON b.cluster_id = r.cluster_id
), f AS (
  SELECT *, CASE WHEN fresh THEN 'create' WHEN NOT bad AND d_maintenance <> a_maintenance THEN 'switch_maintenance'
    WHEN a_maintenance AND (bad OR d_maintenance) THEN 'skip'
    WHEN NOT bad AND rst THEN 'restore' WHEN NOT bad AND (res OR cfg OR rem OR rol OR sch) THEN 'update'
    WHEN NOT bad AND state NOT IN ('ready', 'invalid') THEN 'continue' WHEN needs_reconcile THEN 'recover' ELSE 'idle' END AS action
  FROM e WHERE NOT (fresh AND bad)
)
SELECT cluster_id, action, CASE action WHEN 'create' THEN 'creating' WHEN 'restore' THEN 'restoring' WHEN 'update' THEN 'updating'
    WHEN 'recover' THEN CASE WHEN bad OR state = 'invalid' THEN 'invalid' ELSE 'recovering' END
    ELSE CASE WHEN bad THEN 'invalid' ELSE state END END AS next_state,
  CASE WHEN action = 'create' THEN 'resource,instances,service' WHEN action IN ('restore', 'update') THEN concat_ws(',',
    CASE WHEN res THEN 'resource' END, CASE WHEN res OR cfg OR rem OR rol THEN 'instances' END, CASE WHEN rol THEN 'service' END)
    ELSE '' END AS resets
FROM f
""")
def _(fx):
    # a spec that passes the checks again is no longer invalid
    known = fx("fx_cluster").select("cluster_id", F.when(F.col("state") == "invalid", "ready").otherwise(F.col("state")).alias("state"))
    return decide(specs(fx).join(known, KEY), health_of(fx), KEY)
