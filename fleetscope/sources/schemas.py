"""Declared schemas of the fleet tables. Passwords are not part of any of them."""

ENTRY = "struct<ip:string,node_name:string,extend_ip:string>"
SCHEDULE = (
    "struct<process_timeout:int,grace_period:int,toleration:int,most_available_timeout:int,nodes:array<string>,"
    "polling_period:bigint,liveness_period:int,readiness_period:int,node_labels:map<string,string>>"
)
SPEC_FIELDS = (
    "read_port:int,write_port:int,db_port:int,secret_fingerprint:string,image:string,sidecar_image:string,"
    "local_role:string,cpu:string,memory:string,storage:string,bandwidth:string,sidecar_cpu:string,"
    f"sidecar_memory:string,sidecar_storage:string,ip_list:array<{ENTRY}>,remote_ip_list:array<string>,"
    "backup_path:string,archive_log_path:string,hostpath_root:string,storage_class:string,maintenance:boolean,"
    "config:map<string,string>,script_config:string,filebeat_config:string,restore_file:string,"
    f"schedule:{SCHEDULE},customized_env:map<string,string>,annotations:map<string,string>,"
    "labels:map<string,string>,network_class:string"
)
SPEC = f"struct<{SPEC_FIELDS}>"

SCHEMAS = {
    "cluster_spec": f"namespace string, name string, spec_ts timestamp, spec {SPEC}",
    "cluster_status": (
        "namespace string, name string, poll_ts timestamp, state string, primary_ip string, message string, "
        "conditions array<struct<type:string,status:string,last_update_time:string,message:string>>, "
        "pod_state map<string,string>, "
        "sync_states array<struct<ip:string,percent:int,state:string,priority:int>>, "
        f"restore_phase string, applied {SPEC}"
    ),
    "instance": (
        "namespace string, cluster string, name string, ip string, phase string, created timestamp, node string, "
        "labels map<string,string>, annotations map<string,string>, "
        "containers array<struct<name:string,image:string,cpu:string,memory:string,env:map<string,string>,"
        "readiness_period:int>>, volumes array<struct<name:string,config_map:string>>"
    ),
    "service": (
        "namespace string, cluster string, name string, write boolean, node_port int, port int, target_port int, "
        "selector map<string,string>"
    ),
    "artifact": "namespace string, kind string, artifact string",
    "instance_probe": "namespace string, cluster string, ip string, probe_ts timestamp, probe_text string",
    "lsn_sample": "namespace string, cluster string, ip string, ts timestamp, lsn_text string",
    "event": "ts timestamp, namespace string, cluster string, instance string, type string, reason string, message string",
    "backup_record": "namespace string, cluster string, text string",
    "session": "namespace string, cluster string, ip string, sessionid bigint, state string, state_change timestamp",
}

# fields of the probe text, in the order it prints them
PROBE_FIELDS = {
    "chkprocess": "int", "chkconn": "int", "maintenance": "int", "pending": "int", "primary": "int",
    "standby": "int", "standalone": "int", "hang": "int", "chkrepl": "int", "buildstatus": "int",
    "basebackup": "int", "restore": "int", "connections": "int", "detailinfo": "string",
}
CLUSTER_STATES = ["ready", "creating", "updating", "failed", "maintaining", "invalid", "recovering", "restoring"]
