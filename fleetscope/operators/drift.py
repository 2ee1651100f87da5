"""Desired against actual: members, labels, services, instance specs, artifacts, events."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import maps
from ..functions.quantity import compare, network_rate
from .catalogs import RESTART_PROPERTIES

# fixed values: names the checks compare with
CLUSTER_LABEL, ROLE_LABEL = "cluster", "role"
BUILT_IN_ENV = ["OG_PASSWORD", "MY_POD_IP", "CR_NAME"]
MULTI_NETWORK = "kube-ovn"
ATTACHED_NETWORKS = "k8s.v1.cni.cncf.io/networks"
MOUNT_REASONS = ["failedattachvolume", "failedmount"]
MAIN_CONTAINER, SIDECAR_CONTAINER = "og", "sidecar"
RATE_ANNOTATIONS = ["ovn.kubernetes.io/ingress_rate", "ovn.kubernetes.io/egress_rate"]
BANDWIDTH_ANNOTATIONS = ["kubernetes.io/ingress-bandwidth", "kubernetes.io/egress-bandwidth"]


def both_sides(desired: DataFrame, actual: DataFrame, key: list[str], member: str) -> DataFrame:
    """One row per (key, member) with flags ``wanted`` and ``seen``.

    Stacking and grouping removes duplicates and compares in one shuffle on (key, member),
    which also spreads a very large cluster.
    """
    a = desired.select(*key, member, F.lit(1).alias("w"), F.lit(0).alias("s"))
    b = actual.select(*key, member, F.lit(0).alias("w"), F.lit(1).alias("s"))
    return a.union(b).groupBy(*key, member).agg(
        (F.max("w") == 1).alias("wanted"), (F.max("s") == 1).alias("seen")
    )


def membership_drift(desired: DataFrame, actual: DataFrame, key: list[str], member: str) -> DataFrame:
    """Per key: members missing and beyond, and whether the sets are equal or contain each other."""
    return both_sides(desired, actual, key, member).groupBy(*key).agg(
        F.count_if(F.col("wanted") & ~F.col("seen")).alias("missing"),
        F.count_if(F.col("seen") & ~F.col("wanted")).alias("beyond"),
        F.count_if(F.col("seen") & F.col("wanted")).alias("common"),
    ).select(
        *key, "missing", "beyond", "common",
        ((F.col("missing") == 0) & (F.col("beyond") == 0)).alias("equal"),
        (F.col("missing") == 0).alias("covers_desired"),
    )


def member_union(desired: DataFrame, actual: DataFrame, cols: list[str]) -> DataFrame:
    return desired.select(*cols).union(actual.select(*cols)).distinct()


def member_except(desired: DataFrame, actual: DataFrame, key: list[str], member: str) -> DataFrame:
    """Both differences, labelled."""
    sides = both_sides(desired, actual, key, member).where(F.col("wanted") != F.col("seen"))
    return sides.select(*key, member, F.when(F.col("wanted"), "missing").otherwise("beyond").alias("side"))


def member_intersect(desired: DataFrame, actual: DataFrame, key: list[str], member: str) -> DataFrame:
    common = desired.select(*key, member).intersect(actual.select(*key, member))
    return common.groupBy(*key).agg(F.count("*").alias("common"))


def label_role_mismatch(instances: DataFrame, probes: DataFrame, key: list[str], mismatch: Column) -> DataFrame:
    return instances.join(probes, key).where(mismatch)


def sync_standbys(standbys: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    return standbys.join(sync.where("state = 'Sync'").select(*key), key, "left_semi")


def complete_instances(instances: DataFrame, sync: DataFrame, primary: DataFrame, key: list[str]) -> DataFrame:
    """Instances that are the recorded primary or in state Sync. Both sides meet on (key, ip)."""
    kinds = sync.where("state = 'Sync'").select(*key, "ip").union(primary.select(*key, "ip"))
    return instances.join(kinds, [*key, "ip"], "left_semi")


def expected_artifacts(clusters: DataFrame, key: list[str]) -> DataFrame:
    """Three config maps, one secret and two services per cluster.

    clusters: key, ``namespace``, ``name``, ``script_config``, ``log_config``
    """
    name = F.col("name").cast("string")

    def one(kind, artifact):
        return F.struct(F.lit(kind).alias("kind"), artifact.alias("artifact"))

    wanted = F.array(
        one("ConfigMap", F.concat(F.lit("og-"), name, F.lit("-cm"))),
        one("ConfigMap", F.col("script_config")),
        one("ConfigMap", F.col("log_config")),
        one("Secret", F.concat(name, F.lit("-init-sc"))),
        one("Service", F.concat(F.lit("og-"), name, F.lit("-svc-read"))),
        one("Service", F.concat(F.lit("og-"), name, F.lit("-svc"))),
    )
    return clusters.select(*key, "namespace", F.explode(wanted).alias("a")).select(*key, "namespace", "a.*")


def missing_artifacts(clusters: DataFrame, artifacts: DataFrame, key: list[str]) -> DataFrame:
    return expected_artifacts(clusters, key).join(artifacts, ["namespace", "kind", "artifact"], "left_anti")


def service_drift(clusters: DataFrame, services: DataFrame, key: list[str]) -> DataFrame:
    """One row per wrong field of an existing service; the read one selects standbys, the write one primaries.

    clusters: key, ``name``, ``read_port``, ``write_port``, ``db_port``
    services: key, ``write``, ``node_port``, ``port``, ``target_port``, ``selector`` (map)
    """
    role = F.when(F.col("write"), "primary").otherwise("standby")
    node_port = F.when(F.col("write"), F.col("write_port")).otherwise(F.col("read_port"))
    selector = F.create_map(F.lit(CLUSTER_LABEL), F.col("name").cast("string"), F.lit(ROLE_LABEL), role)

    def wrong(field, cond):
        return F.when(cond, F.lit(field))

    faults = F.array_compact(F.array(
        wrong("node_port", ~F.col("node_port").eqNullSafe(node_port)),
        wrong("port", ~F.col("port").eqNullSafe(F.col("db_port"))),
        wrong("target_port", ~F.col("target_port").eqNullSafe(F.col("db_port"))),
        wrong("selector", maps.differ(F.col("selector"), selector)),
    ))
    return services.join(clusters, key).select(*key, "write", F.explode(faults).alias("field"))


def instance_spec_drift(clusters: DataFrame, instances: DataFrame, key: list[str]) -> DataFrame:
    """One row per instance that differs from the spec, with the reasons in a fixed order.

    clusters: key and ``want_*`` columns; instances: key, ``ip``, observed columns of the same names.
    Besides plain columns: ``want_env`` map against ``container_env`` and ``sidecar_env``; ``extend_ip`` and ``annotations`` of
    the instance against ``spec_annotations``; ``want_configs`` (volume: config map) against ``configs``, each wanted volume by itself.
    Quantities compare by value. The bandwidth annotation is not compared in the network class
    that keeps its rate elsewhere. A sidecar without own image uses the main one.
    """
    want_sidecar = F.when(F.coalesce(F.col("want_sidecar_image"), F.lit("")) == "", F.col("want_image")).otherwise(
        F.col("want_sidecar_image")
    )
    bandwidth = F.coalesce(F.col("want_bandwidth"), F.lit(""))
    checks = [
        ("never_scheduled", F.col("applied_available_timeout") == 0),
        ("image", F.col("image") != F.col("want_image")),
        ("cpu", compare(F.col("cpu"), F.col("want_cpu")) != 0),
        ("memory", compare(F.col("memory"), F.col("want_memory")) != 0),
        ("readiness_period", F.col("readiness_period") != F.col("want_readiness_period")),
        ("sidecar_image", F.col("sidecar_image") != want_sidecar),
        ("sidecar_cpu", compare(F.col("sidecar_cpu"), F.col("want_sidecar_cpu")) != 0),
        ("sidecar_memory", compare(F.col("sidecar_memory"), F.col("want_sidecar_memory")) != 0),
        ("bandwidth", (F.col("network_class") != MULTI_NETWORK) & (F.coalesce(F.col("bandwidth"), F.lit("")) != bandwidth)),
        ("env", _any(env_faults(F.lit(MAIN_CONTAINER), F.col("container_env"), F.col("want_env")))),
        ("sidecar_env", _any(env_faults(F.lit(SIDECAR_CONTAINER), F.col("sidecar_env"), F.col("want_env")))),
        ("extend_ip", (F.col("network_class") == MULTI_NETWORK) & (F.coalesce(F.col("extend_ip"), F.lit("")) != "")
         & extend_ip_reason(F.col("extend_ip"), F.col("annotations"), F.col("spec_annotations")).isNotNull()),
        ("config", F.coalesce(F.exists(
            F.map_entries("want_configs"),
            lambda w: ~F.coalesce(F.try_element_at("configs", w["key"]), F.lit("")).eqNullSafe(w["value"])), F.lit(True))),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(n)) for n, cond in checks]))
    return instances.join(clusters, key).select(*key, "ip", F.array_join(reasons, ",").alias("reasons")).where(
        "reasons <> ''"
    )


def _any(conditions: dict[str, Column]) -> Column:
    first, *rest = conditions.values()
    for c in rest:
        first = first | c
    return first


def env_faults(container: Column, held: Column, want: Column) -> dict[str, Column]:
    """Missing, changed and extra variables of a container. ``want`` has keys ``<container>_<NAME>``.

    A wanted key must be met by a variable whose name occurs in the key, and every such variable must have the
    wanted value; a variable that is neither built in nor wanted is drift. An absent map is an empty one. The two
    maps meet in one row, so nothing is paired across rows.
    """
    none = F.create_map().cast("map<string,string>")
    env, want = F.coalesce(held, none), F.coalesce(want, none)
    wanted, entries = F.map_entries(F.map_filter(want, lambda k, _v: F.startswith(k, container))), F.map_entries(env)

    def related(w):
        return F.filter(entries, lambda h: F.contains(w["key"], h["key"]))

    return {
        "missing": F.exists(wanted, lambda w: F.size(related(w)) == 0),
        "changed": F.exists(wanted, lambda w: F.exists(related(w), lambda h: h["value"] != w["value"])),
        "extra": F.exists(
            F.map_keys(env), lambda n: ~n.isin(BUILT_IN_ENV) & ~F.array_contains(F.map_keys(want), F.concat(container, F.lit("_"), n))),
    }


def env_drift(instances: DataFrame, specs: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Containers whose environment differs from the wanted one, by ``env_faults``.

    specs: key, ``env`` map; instances: key, ``keep`` columns, ``container``, ``container_env`` map.
    """
    faults = env_faults(F.col("container"), F.col("container_env"), F.col("env"))
    return (
        instances.join(specs, key)
        .select(*key, *keep, "container", *[c.alias(n) for n, c in faults.items()])
        .where("missing OR changed OR extra")
    )


def extend_ip_reason(extend_ip: Column, annotations: Column, spec_annotations: Column) -> Column:
    """Why an instance does not carry its second address, or NULL.

    The annotation key is built from the first attached network of the spec.
    """
    attached = F.try_element_at(spec_annotations, F.lit(ATTACHED_NETWORKS))
    networks = F.from_json(attached, "array<struct<name:string,namespace:string>>")
    provider = F.concat(F.get(networks, F.lit(0))["name"], F.lit("."), F.get(networks, F.lit(0))["namespace"], F.lit(".ovn"))
    address = F.try_element_at(annotations, F.concat(provider, F.lit(".kubernetes.io/ip_address")))
    subnet = F.try_element_at(annotations, F.concat(provider, F.lit(".kubernetes.io/logical_switch")))
    return (
        F.when(attached.isNull(), "no_network_annotation")
        .when(provider.isNull(), None)
        .when(address.isNull() & subnet.isNull(), "no_address_annotation")
        .when(~address.eqNullSafe(extend_ip), "other_address")
    )


def _extend_ip_states(members: DataFrame, instances: DataFrame, clusters: DataFrame, key: list[str]) -> DataFrame:
    scope = clusters.where(F.col("network_class") == MULTI_NETWORK).select(*key, "spec_annotations")
    return (
        members.where(F.coalesce(F.col("extend_ip"), F.lit("")) != "")
        .join(instances, [*key, "ip"])
        .join(scope, key)
        .select(*key, "ip", extend_ip_reason(F.col("extend_ip"), F.col("annotations"), F.col("spec_annotations")).alias("reason"))
    )


def extend_ip_drift(members: DataFrame, instances: DataFrame, clusters: DataFrame, key: list[str]) -> DataFrame:
    """Second addresses that the instance does not carry, for the network class that supports them.

    members: key, ``ip``, ``extend_ip``; instances: key, ``ip``, ``annotations`` map;
    clusters: key, ``network_class``, ``annotations`` map (column ``spec_annotations``).
    """
    return _extend_ip_states(members, instances, clusters, key).where("reason IS NOT NULL")


def extend_ip_rollup(members: DataFrame, instances: DataFrame, clusters: DataFrame, key: list[str]) -> DataFrame:
    """Observed members with a second address per cluster, how many do not carry theirs, and the first reason by name."""
    return _extend_ip_states(members, instances, clusters, key).groupBy(*key).agg(
        F.count("*").alias("checked"), F.count("reason").alias("faulty"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("no_network_annotation", "no_address_annotation", "other_address")])


def bandwidth_annotations(clusters: DataFrame, key: list[str]) -> DataFrame:
    """Annotation name and value that limit an instance's traffic, in and out; clusters without a limit have none.

    clusters: key, ``network_class``, ``bandwidth``. One class takes whole megabits, the others the text with its unit.
    """
    own = F.col("network_class") == MULTI_NETWORK
    text = F.coalesce(F.col("bandwidth"), F.lit(""))
    names = F.when(own, F.array(*map(F.lit, RATE_ANNOTATIONS))).otherwise(F.array(*map(F.lit, BANDWIDTH_ANNOTATIONS)))
    value = F.when(own, network_rate(text).cast("string")).otherwise(text)
    return clusters.where(text != "").select(*key, value.alias("value"), F.explode(names).alias("annotation"))


def restart_required(changes: DataFrame, key: list[str], prop: str) -> DataFrame:
    """Whether a changed property needs a restart. The catalog has 117 fixed names, so it is an IN filter."""
    return changes.groupBy(*key).agg(
        F.count("*").alias("changed"), F.max(F.col(prop).isin(RESTART_PROPERTIES)).alias("restart")
    )


def has_mount_reason(reason: Column) -> Column:
    low = F.lower(reason)
    return F.contains(low, F.lit(MOUNT_REASONS[0])) | F.contains(low, F.lit(MOUNT_REASONS[1]))


def mount_failures(instances: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Instances with such an event. Their many repeats are dropped before the join."""
    named = events.where(has_mount_reason(F.col("reason"))).select(*key).distinct()
    return instances.join(named, key, "left_semi")


def mount_wait_exemption(
    members: DataFrame, instances: DataFrame, events: DataFrame, key: list[str], min_age_s: int
) -> DataFrame:
    """Clusters that may form without members stuck on a volume.

    members: key, ``ip``; instances: key, ``ip``, ``ready``, ``phase``, ``age_s``; events: key, ``ip``, ``reason``.
    A member counts when it is ready, or pending for longer than ``min_age_s`` with a mount event.
    """
    failed = mount_failures(instances.where((F.col("phase") == "Pending") & (F.col("age_s") > min_age_s)), events, [*key, "ip"])
    kinds = (
        members.select(*key, "ip", F.lit(1).alias("m"), F.lit(0).alias("r"), F.lit(0).alias("x"))
        .union(instances.where("ready").select(*key, "ip", F.lit(0), F.lit(1), F.lit(0)))
        .union(failed.select(*key, "ip", F.lit(0), F.lit(0), F.lit(1)))
    )
    per_member = kinds.groupBy(*key, "ip").agg(F.max("m").alias("m"), F.max("r").alias("r"), F.max("x").alias("x"))
    counted = per_member.where("m = 1").groupBy(*key).agg(
        F.count("*").alias("desired"), F.sum("r").alias("running"),
        F.count_if((F.col("r") == 0) & (F.col("x") == 1)).alias("exempt"),
    )
    return counted.select(
        *key, "desired", "running", "exempt",
        F.when(F.col("running") == F.col("desired"), "complete")
        .when((F.col("running") == 0) & (F.col("exempt") == F.col("desired")), "all_failed")
        .when((F.col("running") > 0) & (F.col("running") + F.col("exempt") == F.col("desired")), "form_without_failed")
        .otherwise("wait").alias("verdict"),
    )
