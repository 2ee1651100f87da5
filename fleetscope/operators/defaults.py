"""Filling absent spec fields."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import maps
from .change import is_new

# fixed values
TEXT_DEFAULTS = {
    "local_role": "primary",
    "cpu": "1",
    "memory": "4Gi",
    "sidecar_cpu": "500m",
    "sidecar_memory": "1Gi",
    "backup_path": "/data/k8slocalxbk",
    "archive_log_path": "/data/k8slocalogarchive",
}
STORAGE_DEFAULTS = {"storage": "3Gi", "sidecar_storage": "1Gi"}
DB_PORT = 5432
STORAGE_CLASS = "topolvm-provisioner"
NETWORK_CLASS = "calico"
SCHEDULE_DEFAULTS = {
    "process_timeout": 300,
    "grace_period": 30,
    "toleration": 300,
    "most_available_timeout": 60,
    "polling_period": 60,
    "liveness_period": 30,
    "readiness_period": 30,
}
# names that belong to the deployment: pass your own to apply_defaults
SITE_DEFAULTS = {"script_config": "db-script-config", "filebeat_config": "db-log-config"}
SITE_ENV = {"og_MONITOR_TYPE": "DATABASE"}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def apply_defaults(
    specs: DataFrame, site_names: dict[str, str] = SITE_DEFAULTS, site_env: dict[str, str] = SITE_ENV
) -> DataFrame:
    """``desired`` with absent fields filled, and ``updated`` telling whether anything was.

    An existing cluster keeps its applied storage size, and overlays its applied settings.
    Row-local: no shuffle, and the optimizer still prunes fields nobody reads.
    """
    want, have, existing = F.col("desired"), F.col("applied"), ~is_new()
    new, touched = {}, []

    def fill(name, value, absent):
        new[name] = F.when(absent, value).otherwise(want[name])
        touched.append(absent)

    for name, value in {**TEXT_DEFAULTS, **site_names}.items():
        fill(name, F.lit(value), _blank(want[name]))
    for name, value in STORAGE_DEFAULTS.items():
        kept = F.when(existing & ~_blank(have[name]), have[name]).otherwise(F.lit(value))
        fill(name, kept, _blank(want[name]))
    fill("db_port", F.lit(DB_PORT), F.coalesce(want["db_port"], F.lit(0)) == 0)
    fill("storage_class", F.lit(STORAGE_CLASS), _blank(want["hostpath_root"]) & _blank(want["storage_class"]))
    fill("network_class", F.lit(NETWORK_CLASS), existing & _blank(want["network_class"]))
    env = F.create_map(*[F.lit(x) for pair in site_env.items() for x in pair])
    fill("customized_env", env, F.coalesce(F.size(want["customized_env"]), F.lit(0)) <= 0)
    config = maps.merged(have["config"], want["config"])
    new["config"] = config
    touched.append(maps.differ(want["config"], config))
    schedule = {}
    for name, value in SCHEDULE_DEFAULTS.items():
        absent = F.coalesce(want["schedule"][name], F.lit(0)) == 0
        kind = "bigint" if name == "polling_period" else "int"
        schedule[name] = F.when(absent, F.lit(value).cast(kind)).otherwise(want["schedule"][name])
        touched.append(absent)
    fields = specs.schema["desired"].dataType
    new["schedule"] = F.struct(*[
        schedule.get(n, want["schedule"][n]).alias(n) for n in fields["schedule"].dataType.fieldNames()
    ])
    filled = F.struct(*[new.get(n, want[n]).alias(n) for n in fields.fieldNames()])
    updated = touched[0]
    for t in touched[1:]:
        updated = updated | t
    return specs.withColumns({"desired": filled, "updated": updated})
