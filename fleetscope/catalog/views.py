"""Views that turn the shared tables into fleet facts. Whole tables, no subsets."""

from .registry import view


def address(cluster: str, slot: str) -> str:
    return (
        f"concat('10.', CAST({cluster} % 3 AS STRING), '.', CAST(({slot} * 37) % 11 AS STRING), '.', "
        f"CAST({slot} AS STRING))"
    )


view("fx_cluster", f"""
SELECT o_orderkey AS cluster_id, o_custkey AS namespace_id,
       CASE WHEN o_orderstatus = 'F' THEN 'standby' ELSE 'primary' END AS local_role,
       CAST(o_orderkey % 7 + 1 AS INT) AS recorded_slot,
       {address('o_orderkey', '(o_orderkey % 7 + 1)')} AS recorded_primary,
       o_orderkey % 5 = 0 AS is_new, o_orderkey % 13 = 0 AS role_changed,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN 12 ELSE o_orderkey % 5 + 1 END AS INT) AS want_slots,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS INT) AS remote_count,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'recovering' WHEN '2-HIGH' THEN 'updating'
            WHEN '3-MEDIUM' THEN 'invalid' WHEN '5-LOW' THEN 'maintaining' ELSE 'ready' END AS state,
       o_orderdate AS spec_ts
FROM orders
""")

view("fx_member", f"""
SELECT cluster_id, CAST(slot AS INT) AS slot, {address('cluster_id', 'slot')} AS ip
FROM (SELECT cluster_id, $each(want_slots) AS slot FROM fx_cluster) m
""")

view("fx_remote", """
SELECT cluster_id, CAST(slot AS INT) AS slot,
       concat('10.8.', CAST(cluster_id % 200 AS STRING), '.', CAST(slot AS STRING)) AS ip
FROM (SELECT cluster_id, $each(remote_count) AS slot FROM fx_cluster WHERE remote_count > 0) r
""")

view("fx_probe", f"""
SELECT l_orderkey AS cluster_id, l_linenumber AS slot, {address('l_orderkey', 'l_linenumber')} AS ip,
       l_shipdate AS probe_ts,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS f_primary,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS f_standby,
       CASE WHEN l_returnflag = 'N' AND l_partkey % 3 > 0 THEN 1 ELSE 0 END AS f_pending,
       CASE WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 AND l_partkey % 2 = 0 THEN 1 ELSE 0 END AS f_standalone,
       CASE WHEN l_quantity = 49 THEN 1 ELSE 0 END AS f_hang,
       CASE WHEN l_linestatus = 'O' OR l_partkey % 2 = 0 THEN 1 ELSE 0 END AS f_normal,
       CASE WHEN l_quantity > 2 THEN 1 ELSE 0 END AS f_process,
       CASE WHEN l_quantity > 4 THEN 1 ELSE 0 END AS f_conn,
       CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS f_maint,
       CAST(l_suppkey % 5 AS INT) AS build_code, CAST(l_partkey % 5 AS INT) AS backup_code,
       CAST(l_partkey % 4 AS INT) AS restore_code, CAST(l_suppkey % 8 AS INT) AS connections,
       CASE WHEN l_partkey % 13 = 0 THEN 'Disconnected' WHEN l_partkey % 17 = 0 THEN 'Connecting...'
            WHEN l_partkey % 5 = 0 THEN '' ELSE 'Normal' END AS detail,
       CASE WHEN l_partkey % 19 = 0 THEN 'Pending' ELSE 'Running' END AS phase,
       l_partkey % 23 > 0 AS port_open,
       CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 'standby'
            WHEN l_returnflag = 'R' THEN 'primary' ELSE 'standby' END AS role_tag,
       CASE WHEN l_partkey % 53 = 0 THEN NULL
            WHEN l_partkey % 41 = 0 THEN concat('0/', hex(l_partkey % 12))
            WHEN l_partkey % 43 = 0 THEN concat('1F0000000A,0/', hex(l_partkey % 12))
            ELSE concat(' at ', hex(l_suppkey % 2), ',', hex(l_suppkey % 3), '/', hex(l_partkey % 12)) END AS lsn_text,
       CAST(round(l_discount * 100) AS INT) * 10 AS usage_pct,
       l_partkey AS k1, l_suppkey AS k2, l_quantity AS k3, l_extendedprice AS k4
FROM lineitem
""")

view("fx_probe_json", """
SELECT cluster_id, slot, k1, k2, CAST(k3 AS INT) AS k3, CAST(round(k4 * 100) AS BIGINT) AS k4, f_process, f_conn, f_primary, f_standby, f_pending, f_normal, build_code, detail,
       CASE WHEN k1 % 97 = 0 THEN '{broken' WHEN k1 % 89 = 0 THEN ''
            ELSE concat('{"chkprocess":', CAST(f_process AS STRING), ',', chr(10), '"chkconn":', CAST(f_conn AS STRING),
                        ',"primary":', CAST(f_primary AS STRING), ',"standby":', CAST(f_standby AS STRING),
                        ',"pending":', CAST(f_pending AS STRING), ',"chkrepl":', CAST(f_normal AS STRING),
                        CASE WHEN k1 % 2 = 0 THEN concat(', "buildstatus":', CAST(build_code AS STRING)) ELSE '' END,
                        ', "detailinfo":"', detail, '"}', chr(10)) END AS probe_text
FROM fx_probe
""")

view("fx_sync", """
SELECT cluster_id, slot, ip, probe_ts,
       CASE WHEN k1 % 4 = 0 THEN NULL WHEN k2 % 3 = 0 THEN 'Potential' WHEN k2 % 3 = 1 THEN 'Sync' ELSE 'Async' END AS state,
       CASE WHEN k1 % 4 = 0 THEN NULL ELSE CAST(k2 % 2 + 1 AS INT) END AS priority,
       CASE WHEN k1 % 4 = 0 THEN NULL ELSE usage_pct END AS percent, k1, k2, k3, k4
FROM fx_probe WHERE f_standby = 1
""")

view("fx_ha_report", """
SELECT cluster_id, slot, k1, k2, CAST(k3 AS INT) AS k3, CAST(round(k4 * 100) AS BIGINT) AS k4,
       ip, percent, state, priority, k1 % 7 > 0 AS from_primary,
       CASE WHEN state IS NOT NULL THEN concat(' HA state:', chr(10), '   local_role : Primary', chr(10), ' Senders info:', chr(10),
              '   sender_pid                     : ', CAST(k1 AS STRING), chr(10),
              '   sync_percent                   : ', CAST(percent AS STRING), '%', chr(10),
              '   sync_state                     : ', state, chr(10),
              '   sync_priority                  : ', CAST(priority AS STRING), chr(10),
              '   channel                        : 10.0.0.1:5434-->', ip, ':44514', chr(10),
              CASE WHEN k2 % 5 = 0 THEN concat(
              '   sender_pid : 7', chr(10), '   sync_state : Async', chr(10),
              '   sync_priority : 0', chr(10), '   channel : 10.0.0.1:5434-->10.9.9.9:44514', chr(10)) ELSE '' END,
              ' Receiver info:', chr(10), 'No information', chr(10)) END AS report_text
FROM fx_sync
""")

view("fx_usage", """
SELECT user_id AS instance_id, ts, event_id, CASE WHEN event_id % 101 = 0 THEN 'n/a'
       ELSE concat(CAST(CAST(floor(CASE WHEN value > 100 THEN 100 ELSE value END) AS INT) AS STRING), '%') END AS usage_text
FROM events
""")

view("fx_check", """
SELECT user_id AS instance_id, ts, event_id, event_type NOT IN ('error', 'signup', 'view') AS ok FROM events
""")

view("fx_sync_count", """
SELECT user_id AS cluster_id, ts, event_id, CAST(event_id % 4 AS INT) AS synced, CAST(user_id % 3 AS INT) AS expected
FROM events
""")

view("fx_event", """
SELECT event_id, ts, user_id AS cluster_id,
       CASE event_type WHEN 'error' THEN 'FailedMount' WHEN 'click' THEN 'Recorvering' WHEN 'view' THEN 'Ready'
            WHEN 'signup' THEN 'SetPrimary' ELSE 'FailedAttachVolume' END AS reason,
       CASE WHEN event_type IN ('error', 'click', 'purchase') THEN 'Warning' ELSE 'Normal' END AS type
FROM events
""")

view("fx_state", """
SELECT user_id AS cluster_id, ts, event_id,
       CASE event_type WHEN 'click' THEN 'ready' WHEN 'view' THEN 'ready' WHEN 'purchase' THEN 'updating'
            WHEN 'signup' THEN 'creating' ELSE 'recovering' END AS state
FROM events
""")

view("fx_job", """
SELECT user_id AS attempt_id, ts, event_id,
       CAST(CASE WHEN event_id % 61 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS INT) AS job_code,
       CAST(CASE WHEN event_id % 83 = 0 THEN 1 WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 ELSE 0 END AS INT) AS build_code,
       event_id % 3 = 0 AS is_standby, event_id % 59 = 0 AS is_normal
FROM events
""")

view("fx_log", """
SELECT conv_id AS file_id, turn AS seq, role = 'user' AS is_start, text FROM conversations
""")

view("fx_log_event", """
SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'auditlog' WHEN 1 THEN 'syslog' ELSE 'omlog' END AS tag, props
FROM events
""")

view("fx_file", """
SELECT doc_id AS file_id, doc_id % 20 AS cluster_id, n_chars AS bytes, CAST(doc_id % 6 AS INT) AS age_days, text,
       concat('/logs/c', CAST(doc_id % 20 AS STRING), '/10.0.0.', CAST(doc_id % 7 AS STRING), '/archive/',
              CASE doc_id % 4 WHEN 0 THEN 'filebeat.audit.log' WHEN 1 THEN 'log/omm/pg_log/db.log'
                   WHEN 2 THEN 'log/omm/bin/ctl/run.log' ELSE 'log/omm/other.txt' END) AS path
FROM documents
""")

view("fx_quantity", """
SELECT p_partkey AS cluster_id,
       concat(CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'Gi' WHEN p_partkey % 5 = 1 THEN 'G'
              WHEN p_partkey % 5 = 2 THEN 'Mi' WHEN p_partkey % 5 = 3 THEN 'm' ELSE 'Qx' END) AS desired,
       concat(CAST((p_size + p_partkey % 3 - 1) * CASE WHEN p_partkey % 10 = 0 THEN 1024 ELSE 1 END AS STRING),
              CASE WHEN p_partkey % 10 = 0 THEN 'Mi' WHEN p_partkey % 5 = 0 THEN 'Gi' WHEN p_partkey % 5 = 1 THEN 'G'
              WHEN p_partkey % 5 = 2 THEN 'Mi' ELSE 'm' END) AS actual
FROM part
""")

_prop = """
SELECT s_suppkey AS cluster_id, '{k}' AS prop,
       CASE WHEN s_suppkey % {d} = 0 THEN NULL ELSE concat('v', CAST(s_suppkey % {n} AS STRING)) END AS curr_value,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('v', CAST(s_nationkey % {n} AS STRING)) END AS prev_value
FROM supplier
"""
view("fx_config", "UNION ALL".join(
    _prop.format(k=k, n=n, d=d) for k, n, d in (("max_connections", 2, 7), ("work_mem", 3, 4), ("wal_block_size", 4, 6))
))

view("fx_backup", """
SELECT o_orderkey % 50 AS cluster_id, o_orderkey AS backup_id, CAST(o_orderkey % 7200 AS INT) AS duration_s,
       CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status,
       CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
       replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') AS day,
       CAST(floor((o_orderkey % 7200) / 3600) AS INT) AS hh,
       CAST(floor((o_orderkey % 3600) / 60) AS INT) AS mm,
       CAST(o_orderkey % 60 AS INT) AS ss
FROM orders
""")

view("fx_backup_text", """
SELECT cluster_id, backup_id,
       concat('start_time:', day, '000000 ', chr(10), 'end_time:', day, lpad(CAST(hh AS STRING), 2, '0'),
              lpad(CAST(mm AS STRING), 2, '0'), lpad(CAST(ss AS STRING), 2, '0'), ' ', chr(10),
              'backup_status:', status, ' ', chr(10), 'backup_file:/data/backup/', day, '000000.tar ', chr(10),
              'backup_size=', CAST(size_bytes AS STRING)) AS record_text
FROM fx_backup
""")

view("fx_artifact", """
SELECT namespace_id AS namespace, 'ConfigMap' AS kind, concat('og-', CAST(cluster_id AS STRING), '-cm') AS artifact
FROM fx_cluster WHERE cluster_id % 17 > 0
UNION ALL SELECT DISTINCT namespace_id, 'ConfigMap', 'script-config' FROM fx_cluster WHERE namespace_id % 9 > 0
UNION ALL SELECT DISTINCT namespace_id, 'ConfigMap', 'log-config' FROM fx_cluster
UNION ALL SELECT namespace_id, 'Secret', concat(CAST(cluster_id AS STRING), '-init-sc') FROM fx_cluster WHERE cluster_id % 19 > 0
UNION ALL SELECT namespace_id, 'Service', concat('og-', CAST(cluster_id AS STRING), '-svc-read') FROM fx_cluster WHERE cluster_id % 23 > 0
UNION ALL SELECT namespace_id, 'Service', concat('og-', CAST(cluster_id AS STRING), '-svc') FROM fx_cluster
""")

_service = """
SELECT o_orderkey AS cluster_id, {w} AS is_write,
       CAST(CASE WHEN o_orderkey % 11 = 0 THEN 31999 ELSE {p} + o_orderkey % 1000 END AS INT) AS node_port,
       CAST(CASE WHEN o_orderkey % 12 = 0 THEN 5433 ELSE 5432 END AS INT) AS port,
       CAST(CASE WHEN o_orderkey % 18 = 0 THEN 5433 ELSE 5432 END AS INT) AS target_port,
       CASE WHEN o_orderkey % 14 = 0 THEN 'primary' ELSE '{r}' END AS select_role
FROM orders WHERE o_orderkey % {skip} > 0
"""
view("fx_service", "UNION ALL".join([
    _service.format(w="FALSE", p=30000, r="standby", skip=23), _service.format(w="TRUE", p=31000, r="primary", skip=29)
]))

view("fx_env_spec", """
SELECT s_suppkey AS cluster_id, 'og_MONITOR_TYPE' AS key1, concat('v', CAST(s_nationkey % 3 AS STRING)) AS val1,
       CASE WHEN s_suppkey % 2 = 0 THEN 'sidecar_LEVEL' ELSE 'og_EXTRA' END AS key2, 'x' AS val2
FROM supplier
""")

view("fx_env_inst", """
SELECT c_custkey AS instance_id, c_custkey % 100 AS cluster_id, CASE WHEN c_custkey % 3 = 0 THEN 'sidecar' ELSE 'og' END AS container,
       CASE WHEN c_custkey % 5 = 0 THEN 'TYPE' ELSE 'MONITOR_TYPE' END AS name1, concat('v', CAST(c_nationkey % 3 AS STRING)) AS env1,
       CASE c_custkey % 4 WHEN 0 THEN 'LEVEL' WHEN 1 THEN 'EXTRA' WHEN 2 THEN 'CR_NAME' ELSE 'OTHER' END AS name2,
       CASE WHEN c_custkey % 7 = 0 THEN 'y' ELSE 'x' END AS env2
FROM customer
""")

view("fx_net", """
SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'calico' ELSE 'kube-ovn' END AS network_class,
       CASE WHEN cluster_id % 11 = 0 THEN NULL WHEN cluster_id % 10 = 0 THEN '[broken'
            ELSE '[{"name":"net1","namespace":"ns1"}]' END AS networks
FROM fx_cluster
""")

view("fx_ext", """
SELECT cluster_id, ip, slot, CASE WHEN slot % 2 = 0 THEN '' ELSE concat('10.9.0.', CAST(slot AS STRING)) END AS extend_ip,
       CASE WHEN cluster_id % 7 = 0 THEN 'other.ip_address' ELSE 'net1.ns1.ovn.kubernetes.io/ip_address' END AS note_key,
       CASE WHEN cluster_id % 4 = 0 THEN '10.9.0.99' ELSE concat('10.9.0.', CAST(slot AS STRING)) END AS note_value
FROM fx_member
""")

view("fx_inst_spec", """
SELECT p_partkey AS cluster_id, concat('db:', CAST(p_size % 3 AS STRING)) AS want_image,
       CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'side:1' END AS want_sidecar_image,
       '2' AS want_cpu, '4Gi' AS want_memory, '500m' AS want_sidecar_cpu, '1Gi' AS want_sidecar_memory,
       CAST(30 + p_partkey % 2 AS INT) AS want_readiness_period,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2G' END AS want_bandwidth,
       CASE WHEN p_partkey % 4 = 0 THEN 'kube-ovn' ELSE 'calico' END AS network_class,
       concat('og-', CAST(p_partkey AS STRING), '-cm') AS want_config,
       concat('v', CAST(p_size % 2 AS STRING)) AS want_mode, CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE '[{"name":"net1","namespace":"ns1"}]' END AS want_networks,
       CAST(CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 60 END AS INT) AS applied_available_timeout
FROM part
""")

view("fx_inst", """
SELECT l_partkey AS cluster_id, l_orderkey AS instance_id, l_linenumber AS slot, CAST(l_quantity AS INT) AS q, l_suppkey AS k2,
       concat('db:', CAST(l_suppkey % 3 AS STRING)) AS image,
       CASE WHEN l_suppkey % 2 = 0 THEN 'side:1' ELSE concat('db:', CAST(l_suppkey % 3 AS STRING)) END AS sidecar_image,
       CASE WHEN l_suppkey % 4 = 0 THEN '2000m' WHEN l_suppkey % 4 = 1 THEN '1' ELSE '2' END AS cpu,
       CASE WHEN l_suppkey % 5 = 0 THEN '4096Mi' WHEN l_suppkey % 5 = 1 THEN '4G' ELSE '4Gi' END AS memory,
       CASE WHEN l_suppkey % 3 = 0 THEN '0.5' ELSE '500m' END AS sidecar_cpu, '1Gi' AS sidecar_memory,
       CAST(30 + l_suppkey % 2 AS INT) AS readiness_period,
       CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE '2G' END AS bandwidth,
       CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 12 = 0 THEN 'other' ELSE concat('og-', CAST(l_partkey AS STRING), '-cm') END AS config,
       CASE WHEN l_suppkey % 14 = 0 THEN 'old' ELSE 'script' END AS script_config,
       concat('v', CAST(l_suppkey % 2 AS STRING)) AS mode, CASE WHEN l_suppkey % 15 = 0 THEN 'DEBUG' ELSE 'CR_NAME' END AS sidecar_var,
       CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '10.9.0.1' END AS extend_ip,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 6 = 0 THEN '10.9.0.2' ELSE '10.9.0.1' END AS note
FROM lineitem
""")

view("fx_bandwidth", """
SELECT p_partkey AS cluster_id, CASE WHEN p_partkey % 3 = 0 THEN 'calico' ELSE 'kube-ovn' END AS network_class, p_size AS size,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN concat(CAST(p_size AS STRING), '.4M')
            WHEN p_partkey % 5 = 2 THEN concat(CAST(p_size AS STRING), 'G') WHEN p_partkey % 5 = 3 THEN concat('0.', CAST(p_size AS STRING), 'T')
            ELSE '' END AS bandwidth
FROM part
""")

view("fx_session", """
SELECT event_id AS sessionid, user_id AS instance_id, ts AS state_change,
       CASE WHEN event_type IN ('click', 'view') THEN 'idle in transaction' ELSE 'active' END AS state
FROM events
""")

view("fx_spec", """
SELECT o_orderkey AS cluster_id,
       CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE concat('db:', CAST(o_custkey % 4 AS STRING)) END AS d_image,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('db:', CAST(o_custkey % 3 AS STRING)) END AS a_image,
       CAST(CASE WHEN o_orderkey % 31 = 0 THEN 0 WHEN o_orderkey % 37 = 0 THEN 5433 ELSE 5432 END AS INT) AS d_db_port,
       CASE WHEN o_orderkey % 41 = 0 THEN 'f2' ELSE 'f1' END AS d_secret,
       CASE WHEN o_orderkey % 43 = 0 THEN '/data/host' WHEN o_orderkey % 47 = 0 THEN 'data/host' ELSE '' END AS d_hostpath,
       CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 53 = 0 THEN 'slow' ELSE 'fast' END AS d_storage_class,
       CASE WHEN o_orderkey % 6 = 0 THEN 'calico' WHEN o_orderkey % 6 = 1 THEN '' WHEN o_orderkey % 59 = 0 THEN 'flannel'
            ELSE 'kube-ovn' END AS d_network,
       CASE WHEN o_orderkey % 6 = 0 THEN 'calico' WHEN o_orderkey % 6 IN (1, 2) THEN '' ELSE 'kube-ovn' END AS a_network,
       CASE WHEN o_orderkey % 61 = 0 THEN 'leader' WHEN o_orderstatus = 'F' THEN 'standby' WHEN o_orderstatus = 'O' THEN ''
            ELSE 'primary' END AS d_role,
       CAST(CASE WHEN o_orderkey % 67 = 0 THEN 29999 ELSE 30000 + o_orderkey % 1000 END AS INT) AS d_read_port,
       CAST(CASE WHEN o_orderkey % 71 = 0 THEN 32768 ELSE 31000 + o_orderkey % 1000 END AS INT) AS d_write_port,
       CAST(CASE WHEN o_orderkey % 8 = 0 THEN 30001 ELSE 30000 + o_orderkey % 1000 END AS INT) AS a_read_port,
       CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '400m' WHEN 2 THEN 'two' ELSE '2' END AS d_cpu,
       CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN '1Gi' WHEN 2 THEN '4 Gi' ELSE '4Gi' END AS d_memory,
       CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN '2Gi' WHEN 2 THEN 'big' WHEN 3 THEN '5Gi' ELSE '20Gi' END AS d_storage,
       CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '10Gi' END AS a_storage,
       CASE o_orderkey % 12 WHEN 0 THEN '2X' WHEN 1 THEN '2G' ELSE '' END AS d_bandwidth,
       CASE o_orderkey % 13 WHEN 0 THEN '100m' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '0.5' END AS d_side_cpu,
       CASE o_orderkey % 14 WHEN 0 THEN '499Mi' WHEN 1 THEN '1Gig' WHEN 2 THEN '' ELSE '500Mi' END AS d_side_memory,
       CASE o_orderkey % 15 WHEN 0 THEN '1000Mi' WHEN 1 THEN '1GB' WHEN 2 THEN '' WHEN 3 THEN '1.5Gi' ELSE '2Gi' END AS d_side_storage,
       CASE WHEN o_orderkey % 16 = 0 THEN 'backup' WHEN o_orderkey % 16 = 1 THEN '' ELSE '/backup' END AS d_backup_path,
       CASE WHEN o_orderkey % 17 = 0 THEN 'arch' WHEN o_orderkey % 17 = 1 THEN '' ELSE '/arch' END AS d_archive_path,
       CAST(CASE WHEN o_orderkey % 73 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS INT) AS d_members,
       CASE WHEN o_orderkey % 79 = 0 THEN '127.0.0.1' WHEN o_orderkey % 83 = 0 THEN '10.0.0.300'
            WHEN o_orderkey % 89 = 0 THEN 'fd00::1' ELSE '10.1.0.1' END AS d_ip1,
       CASE WHEN o_orderkey % 18 = 0 THEN '10.9.0.1' WHEN o_orderkey % 19 = 0 THEN 'bad' ELSE '' END AS d_ext1,
       CAST(CASE WHEN o_orderkey % 20 < 8 THEN 1 ELSE 0 END AS INT) AS d_remotes,
       CASE WHEN o_orderkey % 21 = 0 THEN '224.0.0.1' ELSE '10.8.0.1' END AS d_remote1,
       CASE o_orderkey % 22 WHEN 0 THEN 'wal_block_size' WHEN 1 THEN '' ELSE 'work_mem' END AS d_config_key,
       CASE WHEN o_orderkey % 2 = 0 THEN 'work_mem' ELSE 'max_connections' END AS a_config_key,
       CASE o_orderkey % 24 WHEN 0 THEN 'MONITOR' WHEN 1 THEN 'og_MY_POD_IP' WHEN 2 THEN '' ELSE 'OG_MODE' END AS d_env_key,
       CASE o_orderkey % 25 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN 'x[' ELSE '[{"networkname":"n","subnetname":"s"}]' END AS d_subnets,
       CASE o_orderkey % 26 WHEN 0 THEN '' WHEN 1 THEN '{' ELSE '[{"name":"n","namespace":"s"}]' END AS d_networks,
       o_orderkey % 27 > 0 AS d_has_switch,
       o_orderkey % 28 = 0 AS d_maintenance, o_orderkey % 32 = 0 AS a_maintenance,
       CASE WHEN o_orderkey % 33 = 0 THEN 'b.tar' ELSE '' END AS d_restore,
       CAST(CASE WHEN o_orderkey % 34 = 0 THEN 0 WHEN o_orderkey % 35 = 0 THEN 60 ELSE 30 END AS INT) AS d_liveness,
       CAST(CASE WHEN o_orderkey % 36 = 0 THEN 0 ELSE 300 END AS INT) AS d_timeout,
       CAST(o_orderkey % 38 AS INT) AS d_nodes
FROM orders
""")

# latest rows, written for the checking engine
view("ox_latest", """
SELECT * FROM fx_probe
QUALIFY row_number() OVER (PARTITION BY cluster_id, slot ORDER BY probe_ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) = 1
""")
view("ox_sync", """
SELECT * FROM fx_sync
QUALIFY row_number() OVER (PARTITION BY cluster_id, slot ORDER BY probe_ts DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) = 1
""")
view("ox_lsn", """
SELECT *, CASE WHEN k1 % 53 = 0 THEN NULL WHEN k1 % 41 = 0 THEN 0 WHEN k1 % 43 = 0 THEN 4294967295 ELSE k2 % 2 END AS ll,
       CASE WHEN k1 % 53 = 0 THEN NULL WHEN k1 % 41 = 0 OR k1 % 43 = 0 THEN 0 ELSE k2 % 3 END AS lm,
       CASE WHEN k1 % 53 = 0 THEN NULL WHEN k1 % 41 = 0 THEN 0 ELSE k1 % 12 END AS lr
FROM ox_latest
""")
view("ox_flags", """
SELECT cluster_id, bool_or(state IS NOT NULL) AS has_states, coalesce(bool_or(state = 'Sync'), false) AS has_sync FROM ox_sync GROUP BY cluster_id
""")
view("ox_cand", """
SELECT p.*, s.state AS sync_state, s.priority, c.local_role, c.recorded_primary, c.is_new, c.role_changed, c.want_slots,
       coalesce(f.has_states, false) AS has_states, coalesce(f.has_sync, false) AS has_sync
FROM ox_lsn p LEFT JOIN ox_sync s USING (cluster_id, slot) JOIN fx_cluster c USING (cluster_id)
LEFT JOIN ox_flags f USING (cluster_id)
""")
