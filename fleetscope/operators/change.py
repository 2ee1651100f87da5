"""Differences between the wanted and the applied spec, and the action they call for.

A spec row holds the structs ``desired`` and ``applied`` of one cluster, so comparing them
needs no shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import maps

# change class of each compared field
SCALARS = {
    "container": [
        "image", "sidecar_image", "cpu", "memory", "bandwidth", "sidecar_cpu", "sidecar_memory",
        "backup_path", "archive_log_path", "script_config", "filebeat_config",
    ],
    "storage": ["storage", "sidecar_storage"],
    "service": ["read_port", "write_port"],
    "role": ["local_role"],
    "restore": ["restore_file"],
    "maintenance": ["maintenance"],
}
MAPS = {"container": ["customized_env"], "config": ["config"], "annotation": ["annotations"], "label": ["labels"]}
# probe periods count for the container as well as for the schedule
CONTAINER_SCHEDULE = ["liveness_period", "readiness_period"]
SCHEDULE = [
    "process_timeout", "grace_period", "toleration", "most_available_timeout", "polling_period",
    "liveness_period", "readiness_period",
]
RESOURCE_CLASSES = ["container", "storage", "service", "entries", "annotation", "label"]
CHANGED_CLASSES = [*RESOURCE_CLASSES, "config", "remote", "role", "restore", "schedule"]


def is_new(applied: Column = None) -> Column:
    applied = F.col("applied") if applied is None else applied
    return F.coalesce(applied["image"], F.lit("")) == ""


def _text(c: Column, absent: str = "") -> Column:
    return F.coalesce(c.cast("string"), F.lit(absent))


# an absent number is 0 and an absent flag is off, as an absent text is blank
_ABSENT = {"read_port": "0", "write_port": "0", "maintenance": "false"}


def _ip_set(entries: Column) -> Column:
    ips = F.transform(F.coalesce(entries, F.array()), lambda e: e["ip"])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(ips, lambda i: i != ""))), ",")


def _entry_set(entries: Column) -> Column:
    lines = F.transform(
        entries, lambda e: F.concat_ws("|", _text(e["ip"]), _text(e["node_name"]), _text(e["extend_ip"]))
    )
    return F.array_join(F.array_sort(F.array_distinct(lines)), ",")


def _remote_set(ips: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(ips, lambda i: i != ""))), ",")


def _size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def _pairs(prev: Column, curr: Column) -> list[tuple[str, str, Column, Column]]:
    out = []
    for kind, names in SCALARS.items():
        out += [(kind, n, _text(prev[n], _ABSENT.get(n, "")), _text(curr[n], _ABSENT.get(n, ""))) for n in names]
    for kind, names in MAPS.items():
        out += [(kind, n, maps.to_text(prev[n]), maps.to_text(curr[n])) for n in names]
    for n in CONTAINER_SCHEDULE:
        out.append(("container", n, _text(prev["schedule"][n], "0"), _text(curr["schedule"][n], "0")))
    for n in SCHEDULE:
        out.append(("schedule", n, _text(prev["schedule"][n], "0"), _text(curr["schedule"][n], "0")))
    out.append(("schedule", "node_labels", maps.to_text(prev["schedule"]["node_labels"]),
                maps.to_text(curr["schedule"]["node_labels"])))

    def counted(a, text):
        return F.concat(_size(a).cast("string"), F.lit(":"), F.coalesce(text, F.lit("")))

    out.append(("members", "ip_list", counted(prev["ip_list"], _ip_set(prev["ip_list"])),
                counted(curr["ip_list"], _ip_set(curr["ip_list"]))))
    out.append(("entries", "ip_list", counted(prev["ip_list"], _entry_set(prev["ip_list"])),
                counted(curr["ip_list"], _entry_set(curr["ip_list"]))))
    out.append(("remote", "remote_ip_list", counted(prev["remote_ip_list"], _remote_set(prev["remote_ip_list"])),
                counted(curr["remote_ip_list"], _remote_set(curr["remote_ip_list"]))))
    return out


def spec_diff(specs: DataFrame, key: list[str]) -> DataFrame:
    """One row per changed field; clusters that were never applied have no differences."""
    found = [
        F.when(old != new, F.struct(
            F.lit(k).alias("class"), F.lit(n).alias("field"), old.alias("old_value"), new.alias("new_value")))
        for k, n, old, new in _pairs(F.col("applied"), F.col("desired"))
    ]
    changed = F.array_compact(F.array(*found))
    return specs.where(~is_new()).select(*key, F.explode(changed).alias("d")).select(*key, "d.*")


def spec_change_flags(specs: DataFrame, key: list[str]) -> DataFrame:
    """One row per cluster with a flag per change class; all false for a new cluster but ``changed``.

    The differences are taken once, as the set of changed classes of the row.
    """
    classes = F.array_distinct(F.array_compact(F.array(*[
        F.when(old != new, F.lit(k)) for k, _n, old, new in _pairs(F.col("applied"), F.col("desired"))
    ])))
    names = ["container", "storage", "service", "members", "entries", "remote", "config", "annotation", "label",
             "role", "restore", "maintenance", "schedule"]
    found = specs.select(*key, is_new().alias("is_new"), classes.alias("c"))

    def has(kinds):
        return F.arrays_overlap("c", F.array(*[F.lit(k) for k in kinds]))

    return found.select(
        *key, "is_new",
        *[(~F.col("is_new") & F.array_contains("c", n)).alias(f"{n}_changed") for n in names],
        (~F.col("is_new") & has(RESOURCE_CLASSES)).alias("resource_changed"),
        has(CHANGED_CLASSES).alias("changed"),
    )


def config_delta(settings: DataFrame, key: list[str]) -> DataFrame:
    """Settings that are new or changed; removed settings are not reported.

    One row per setting: key, ``prop``, ``prev_value`` (applied), ``curr_value`` (wanted). The
    map form of a single spec is ``maps.changed``.
    """
    return settings.where(
        F.col("curr_value").isNotNull() & ~F.col("curr_value").eqNullSafe(F.col("prev_value"))
    ).select(*key, "prop", F.col("curr_value").alias("value"))


def config_effective(settings: DataFrame, key: list[str]) -> DataFrame:
    """Applied settings overlaid with the wanted ones; nothing for a key that wants none.

    The map form of a single spec is ``maps.merged``.
    """
    wanted = settings.where(F.col("curr_value").isNotNull()).select(*key).distinct()
    return settings.join(wanted, key, "left_semi").select(
        *key, "prop", F.coalesce("curr_value", "prev_value").alias("value")
    ).where("value IS NOT NULL")


def plan_action(states: DataFrame, key: list[str]) -> DataFrame:
    """Next action of each cluster, the state it moves to and the conditions it resets.

    states: key, ``is_new``, ``state``, ``maintenance_changed``, ``in_maintenance`` (wanted and
    applied), the class flags of ``spec_change_flags`` and ``needs_reconcile``.
    """
    action = (
        F.when(F.col("is_new"), "create")
        .when(F.col("maintenance_changed"), "switch_maintenance")
        .when(F.col("in_maintenance"), "skip")
        .when(F.col("changed") & F.col("restore_changed"), "restore")
        .when(F.col("changed"), "update")
        .when(~F.col("state").isin("ready", "invalid"), "continue")
        .when(F.col("needs_reconcile"), "recover")
        .otherwise("idle")
    )
    spec_action = F.col("action").isin("restore", "update")
    created = F.col("action") == "create"
    resource = created | (spec_action & F.col("resource_changed"))
    instances = created | (
        spec_action
        & (F.col("resource_changed") | F.col("config_changed") | F.col("remote_changed") | F.col("role_changed"))
    )
    service = created | (spec_action & F.col("role_changed"))
    next_state = (
        F.when(created, "creating").when(F.col("action") == "restore", "restoring")
        .when(F.col("action") == "update", "updating")
        .when((F.col("action") == "recover") & (F.col("state") != "invalid"), "recovering")
        .otherwise(F.col("state"))
    )
    resets = F.concat_ws(
        ",", F.when(resource, "resource"), F.when(instances, "instances"), F.when(service, "service")
    )
    return states.withColumn("action", action).select(
        *key, "action", next_state.alias("next_state"), resets.alias("resets")
    )
