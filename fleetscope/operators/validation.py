"""Spec rules. Each spec row yields the array of its violations without any shuffle.

The rules are SQL text over the structs ``desired`` (d) and ``applied`` (a), so that the whole
list is parsed once instead of being assembled call by call.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.net import GLOBAL_UNICAST_SQL
from ..functions.quantity import PATTERN, billionths
from .catalogs import INTERNAL_PROPERTIES
from .change import is_new

# fixed values
PORT_MIN, PORT_MAX = 30000, 32767
MINIMUM = {
    "cpu": "500m", "memory": "2Gi", "storage": "3Gi",
    "sidecar_cpu": "200m", "sidecar_memory": "500Mi", "sidecar_storage": "1Gi",
}
ENV_PREFIX = "(?i)og_|sidecar_"
RESERVED_ENV = ["og_OG_PASSWORD", "og_MY_POD_IP", "sidecar_CR_NAME", "sidecar_MY_POD_IP"]
SINGLE_NETWORK, MULTI_NETWORK = "calico", "kube-ovn"
SUBNET = "ovn.kubernetes.io/logical_switch"
ATTACHED_NETWORKS = "k8s.v1.cni.cncf.io/networks"
ATTACHED_SUBNETS = "attach_logical_switch_array"
MESSAGE_PREFIX = "spec check failed: "


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _blank(field: str) -> str:
    return f"coalesce(d.{field}, '') = ''"


def _frozen(field: str, absent: str = "''") -> str:
    """Must stay as applied; an absent value equals a blank or zero one."""
    return f"NOT _new AND coalesce(d.{field}, {absent}) <> coalesce(a.{field}, {absent})"


def _sized(field: str, parse: str, low: str, shrink: str = None) -> list[tuple[str, str, str]]:
    """Unreadable, below the minimum, or below what is applied. An absent or unreadable applied size is 0."""
    rules = [
        (parse, field, f"NOT {_blank(field)} AND NOT d.{field} RLIKE {_raw(PATTERN)}"),
        (low, field, f"_q.{field} < _m.{field}"),
    ]
    if shrink:
        rules.append((shrink, field, f"NOT _new AND _q.{field} >= _m.{field} AND _q.{field} < coalesce(_q.applied_{field}, 0)"))
    return rules


def _absolute(rule: str, field: str) -> tuple[str, str, str]:
    return rule, field, f"NOT {_blank(field)} AND NOT startswith(d.{field}, '/')"


# rule id, field, condition under which the field is wrong
ROW_RULES = [
    ("V01", "image", _blank("image")),
    ("V02", "db_port", _frozen("db_port", "0")),
    ("V03", "secret_fingerprint", _frozen("secret_fingerprint")),
    ("V04", "hostpath_root", _frozen("hostpath_root")),
    ("V05", "storage_class", _frozen("storage_class")),
    ("V06", "network_class", _frozen("network_class") + " AND coalesce(a.network_class, '') <> ''"),
    ("V07", "local_role", "coalesce(d.local_role, '') NOT IN ('', 'primary', 'standby')"),
    ("V08", "read_port", f"coalesce(d.read_port, 0) NOT BETWEEN {PORT_MIN} AND {PORT_MAX}"),
    ("V09", "write_port", f"coalesce(d.write_port, 0) NOT BETWEEN {PORT_MIN} AND {PORT_MAX}"),
    *_sized("cpu", "V10", "V11"),
    *_sized("memory", "V12", "V13"),
    *_sized("storage", "V14", "V15", "V16"),
    ("V17", "bandwidth", f"NOT {_blank('bandwidth')} AND NOT d.bandwidth RLIKE {_raw(PATTERN)}"),
    *_sized("sidecar_cpu", "V18", "V19"),
    *_sized("sidecar_memory", "V20", "V21"),
    *_sized("sidecar_storage", "V22", "V23", "V24"),
    ("V25", "hostpath_root", f"NOT {_blank('hostpath_root')} AND NOT {_blank('storage_class')}"),
    ("V26", "network_class", f"_new AND coalesce(d.network_class, '') NOT IN ('{SINGLE_NETWORK}', '{MULTI_NETWORK}')"),
    ("V27", "annotations", f"_new AND d.network_class = '{MULTI_NETWORK}' AND NOT coalesce(map_contains_key(d.annotations, '{SUBNET}'), false)"),
    _absolute("V28", "hostpath_root"),
    _absolute("V29", "backup_path"),
    _absolute("V30", "archive_log_path"),
    ("V31", "ip_list", "coalesce(size(d.ip_list), 0) <= 0"),
    ("V36", "remote_ip_list", "d.local_role = 'standby' AND coalesce(size(d.remote_ip_list), 0) <= 0"),
    ("V39", "schedule", f"coalesce(d.network_class, '') <> '{MULTI_NETWORK}' AND (size(d.schedule.nodes) > 0 OR size(d.schedule.node_labels) > 0)"),
]

# rule id, field, elements, condition under which element e is wrong, value reported
_MULTI = f"d.network_class = '{MULTI_NETWORK}' AND coalesce(e.extend_ip, '') <> ''"
ELEMENT_RULES = [
    ("V32", "ip_list", "d.ip_list", f"NOT {GLOBAL_UNICAST_SQL.format(ip='e.ip')}", "e.ip"),
    ("V33", "extend_ip", "d.ip_list", f"{_MULTI} AND (NOT _notes_ok OR NOT {GLOBAL_UNICAST_SQL.format(ip='e.extend_ip')})", "e.extend_ip"),
    ("V34", "extend_ip", "d.ip_list", f"d.network_class = '{SINGLE_NETWORK}' AND coalesce(e.extend_ip, '') <> ''", "e.extend_ip"),
    ("V35", "remote_ip_list", "d.remote_ip_list", f"NOT {GLOBAL_UNICAST_SQL.format(ip='e')}", "e"),
    ("V37", "config", "map_keys(d.config)", f"NOT _new AND e IN ({_in(INTERNAL_PROPERTIES)})", "e"),
    ("V38", "customized_env", "map_keys(d.customized_env)", f"NOT e RLIKE {_raw(ENV_PREFIX)} OR e IN ({_in(RESERVED_ENV)})", "e"),
]

_NOTES_OK = f"""
coalesce(size(from_json(d.annotations['{ATTACHED_SUBNETS}'], 'array<struct<networkname:string,subnetname:string>>')) = 1, false)
AND from_json(d.annotations['{ATTACHED_NETWORKS}'], 'array<struct<name:string,namespace:string>>') IS NOT NULL
"""
# map and list fields report their elements, not themselves
_NO_VALUE = ["annotations", "ip_list", "remote_ip_list", "schedule", "image"]


def _entry(rule: str, field: str, value: str) -> str:
    return f"named_struct('rule', '{rule}', 'field', '{field}', 'value', coalesce(string({value}), ''))"


def _violations_sql() -> str:
    rows = ", ".join(
        f"CASE WHEN {cond} THEN {_entry(rule, field, repr('') if field in _NO_VALUE else f'd.{field}')} END"
        for rule, field, cond in ROW_RULES
    )
    lists = ", ".join(
        f"coalesce(transform(filter({items}, e -> coalesce({cond}, false)), e -> {_entry(rule, field, value)}), _none)"
        for rule, field, items, cond, value in ELEMENT_RULES
    )
    return f"array_sort(concat(array_compact(array({rows})), {lists}))"


def with_violations(specs: DataFrame) -> DataFrame:
    """Add ``violations``. Sizes and annotations are parsed once per row, before the rules read them."""
    want, have = F.col("desired"), F.col("applied")
    sizes = {f: billionths(want[f]) for f in MINIMUM}
    sizes |= {f"applied_{f}": billionths(have[f]) for f in ("storage", "sidecar_storage")}
    prepared = specs.select(
        "*", want.alias("d"), have.alias("a"), is_new().alias("_new"),
        F.struct(*[c.alias(n) for n, c in sizes.items()]).alias("_q"),
        F.struct(*[billionths(F.lit(v)).alias(n) for n, v in MINIMUM.items()]).alias("_m"),
        F.expr("cast(array() as array<struct<rule:string,field:string,value:string>>)").alias("_none"),
    ).withColumn("_notes_ok", F.expr(_NOTES_OK))
    return prepared.select(*specs.columns, F.expr(_violations_sql()).alias("violations"))


def validate_specs(specs: DataFrame, key: list[str]) -> DataFrame:
    """One row per violation."""
    return with_violations(specs).select(*key, F.explode("violations").alias("v")).select(*key, "v.*")


def verdicts(checked: DataFrame, key: list[str]) -> DataFrame:
    """What an invalid spec means: a new cluster stops, an existing one keeps its last valid spec.

    ``message`` joins the violations of the row in rule order.
    """
    n = F.size("violations")
    lines = F.transform("violations", lambda v: F.concat(v["rule"], F.lit(" "), v["field"], F.lit("="), v["value"]))
    return checked.select(
        *key, n.alias("violation_count"),
        F.when(n == 0, "valid").when(is_new(), "stop").otherwise("keep_last_valid").alias("verdict"),
        F.when(n > 0, F.concat(F.lit(MESSAGE_PREFIX), F.array_join(lines, "\n"))).otherwise("").alias("message"),
    )


def valid_spec() -> Column:
    """The spec to act on: the wanted one while the cluster is valid, else the applied one."""
    return F.when(F.col("state") == "invalid", F.col("applied")).otherwise(F.col("desired"))
