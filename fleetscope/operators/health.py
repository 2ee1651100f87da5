"""Cluster verdicts from the latest instance facts."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.net import instance_name
from .drift import expected_artifacts
from .predicates import is_ready, label_mismatch, needs_configure


def expected_sync(local: Column, remote: Column) -> Column:
    """Replicas that should be synchronous."""
    return F.when(remote > 0, local).when(local >= 2, F.floor(local / 2)).otherwise(0).cast("bigint")


def instance_condition(label: Column, recorded_state: Column, summary: Column) -> list[Column]:
    """Condition flags of one observed instance, evaluated in the order the checks stop each other."""
    ready = F.coalesce(is_ready(), F.lit(False))
    known = F.col("chkprocess").isNotNull()
    maintenance = ready & known & (F.col("maintenance") == 1)
    unconfigured = ready & known & ~maintenance & needs_configure()
    mislabelled = ready & known & ~unconfigured & label_mismatch(label)
    settled = ready & known & ~unconfigured & ~mislabelled
    return [
        (~ready).alias("not_running"),
        maintenance.alias("in_maintenance"),
        unconfigured.alias("unconfigured"),
        mislabelled.alias("mislabelled"),
        (ready & known & (F.col("primary") == 1)).alias("runs_primary"),
        (settled & ~summary.eqNullSafe(recorded_state)).alias("state_changed"),
    ]


def cluster_health(
    clusters: DataFrame, members: DataFrame, instances: DataFrame, artifacts: DataFrame | None, key: list[str],
    extend_faults: DataFrame | None = None,
) -> DataFrame:
    """Verdict per cluster: whether it needs repair, three condition flags and the causes.

    clusters: key, ``local_role``, ``recorded_primary`` (and the columns expected_artifacts needs)
    members: key, ``ip``
    instances: latest facts per key and ``ip``, with the flags of ``instance_condition``
    extend_faults: key and ``faulty``, as ``extend_ip_rollup`` gives them; a cluster with any needs repair
    Member and instance rows are stacked and reduced per (key, ip), then per key; every shuffle
    carries partial counts, so a very large cluster is no larger than a small one.
    """
    flags = ["not_running", "in_maintenance", "unconfigured", "mislabelled", "runs_primary", "state_changed"]
    wanted = members.select(*key, "ip", F.lit(1).alias("w"))
    seen = instances.select(*key, "ip", F.lit(1).alias("s"), *[F.col(f).cast("int").alias(f) for f in flags])
    recorded = clusters.where(F.coalesce("recorded_primary", F.lit("")) != "").select(
        *key, F.col("recorded_primary").alias("ip"), F.lit(1).alias("r")
    )
    rows = wanted.unionByName(seen, allowMissingColumns=True).unionByName(recorded, allowMissingColumns=True)
    # only numbers are aggregated from here on, so every step is a hash aggregate
    per_instance = rows.groupBy(*key, "ip").agg(*[
        F.coalesce(F.max(f), F.lit(0)).alias(f) for f in ["w", "s", "r", *flags]
    ])
    primary = F.col("runs_primary") == 1
    per_cluster = per_instance.groupBy(*key).agg(
        F.count_if(F.expr("w = 1 AND s = 0")).alias("members_missing"),
        F.count_if(F.expr("w = 0 AND s = 1")).alias("members_beyond"),
        F.sum(F.greatest("not_running", "unconfigured", "mislabelled")).alias("not_ready"),
        F.sum("in_maintenance").alias("in_maintenance"),
        F.sum("mislabelled").alias("mislabelled"),
        F.sum("state_changed").alias("state_changed"),
        F.sum("runs_primary").alias("primaries"),
        F.count_if(primary & (F.col("w") == 1)).alias("member_primaries"),
        F.count_if(primary & (F.col("r") == 1)).alias("recorded_primaries"),
    )
    facts = clusters.join(per_cluster, key, "left")
    if artifacts is None:
        facts = facts.withColumn("artifacts_missing", F.lit(0).cast("bigint"))
    else:
        held = artifacts.select("namespace", "kind", "artifact").distinct().withColumn("held", F.lit(1))
        lost = (
            expected_artifacts(clusters, key).join(held, ["namespace", "kind", "artifact"], "left")
            .groupBy(*key).agg(F.count_if(F.col("held").isNull()).alias("artifacts_missing"))
        )
        facts = facts.join(lost, key, "left")
    if extend_faults is None:
        facts = facts.withColumn("extend_ip_wrong", F.lit(0).cast("bigint"))
    else:
        facts = facts.join(extend_faults.select(*key, F.col("faulty").alias("extend_ip_wrong")), key, "left")
    counts = [
        "members_missing", "members_beyond", "not_ready", "in_maintenance", "mislabelled", "state_changed",
        "primaries", "artifacts_missing", "extend_ip_wrong",
    ]
    facts = facts.withColumns({
        c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in [*counts, "member_primaries", "recorded_primaries"]
    })
    role_primary = F.coalesce(F.col("local_role"), F.lit("")).isin("", "primary")
    drift = (F.col("members_missing") + F.col("members_beyond")) > 0
    wrong_primary = F.when(
        role_primary,
        (F.col("primaries") != 1) | (F.col("member_primaries") != 1) | (F.col("recorded_primaries") != 1),
    ).otherwise(F.col("primaries") != 0)
    causes = {
        "maintenance": F.col("in_maintenance") > 0,
        "members": drift,
        "primary": wrong_primary,
        "not_ready": F.col("not_ready") > 0,
        "artifacts": F.col("artifacts_missing") > 0,
        "extend_ip": F.col("extend_ip_wrong") > 0,
    }
    facts = facts.withColumns({f"_{n}": c for n, c in causes.items()})
    on = {n: F.col(f"_{n}") for n in causes}
    return facts.select(
        *key, *counts,
        (on["maintenance"] | on["members"] | on["primary"] | on["not_ready"] | on["artifacts"] | on["extend_ip"]).alias("needs_reconcile"),
        (~on["members"] & ~on["artifacts"]).alias("resource_ready"),
        (~on["maintenance"] & ~on["members"] & ~on["primary"] & ~on["not_ready"]).alias("instances_ready"),
        (~on["primary"] & ~on["artifacts"]).alias("service_ready"),
        F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in on.items()]).alias("causes"),
    )


def primary_cardinality(clusters: DataFrame, members: DataFrame, probes: DataFrame, key: list[str]) -> DataFrame:
    """How many primaries run, and whether the single one is a member and the recorded one.

    probes: latest row per key and ``ip`` with ``is_primary``
    """
    marked = probes.where("is_primary").select(*key, "ip").join(
        members.select(*key, "ip", F.lit(True).alias("m")), [*key, "ip"], "left"
    )
    counted = marked.groupBy(*key).agg(
        F.count("*").alias("primaries"), F.min("ip").alias("primary_ip"),
        F.max(F.coalesce("m", F.lit(False))).alias("is_member"),
    )
    facts = clusters.join(counted, key, "left").withColumn("primaries", F.coalesce("primaries", F.lit(0)))
    n, standby = F.col("primaries"), F.col("local_role") == "standby"
    one = n == 1
    return facts.select(
        *key, "primaries",
        F.when((n > 1) | (standby & (n >= 1)), "multiple").when(one, "one")
        .when(standby, "expected_none").otherwise("none").alias("verdict"),
        (one & ~F.coalesce("is_member", F.lit(False))).alias("primary_not_member"),
        (one & ~F.col("primary_ip").eqNullSafe(F.col("recorded_primary"))).alias("primary_not_recorded"),
    )


def replica_sync_gap(clusters: DataFrame, sync: DataFrame, key: list[str], local: str, remote: str) -> DataFrame:
    synced = sync.groupBy(*key).agg(F.count_if(F.expr("state = 'Sync'")).alias("synced"))
    expected = expected_sync(F.col(local), F.col(remote))
    return clusters.join(synced, key, "left").select(
        *key, expected.alias("expected"), F.coalesce("synced", F.lit(0)).alias("synced"),
        (expected - F.coalesce("synced", F.lit(0))).alias("gap"),
    )


def distinct_members(members: DataFrame, key: list[str], member: str) -> DataFrame:
    """Set semantics: blanks ignored, duplicates collapsed; counts of both."""
    per_member = members.where(F.coalesce(F.col(member), F.lit("")) != "").groupBy(*key, member).count()
    return per_member.groupBy(*key).agg(
        F.count("*").alias("members"),
        F.sum("count").alias("entries"),
        F.count_if(F.expr("count > 1")).alias("duplicated"),
    )


def fleet_members(members: DataFrame, namespace: str, key: list[str], member: str, lg_k: int = 12) -> DataFrame:
    """Members of each namespace and, with a NULL namespace, of the fleet: exactly, and from sketches.

    Each cluster has one sketch of its members; a level's sketch is the union of those below it, so that a new level, or
    another day's clusters, needs no second look at the members. ``lg_k`` of 12 keeps the error near 1.6 %.
    """
    known = members.where(F.coalesce(F.col(member), F.lit("")) != "")
    exact = known.rollup(namespace).agg(F.grouping(namespace).alias("_fleet"), F.count_distinct(member).alias("members"), F.count("*").alias("entries"))
    sketches = known.groupBy(namespace, *key).agg(F.hll_sketch_agg(member, F.lit(lg_k)).alias("_sketch"))
    merged = sketches.rollup(namespace).agg(
        F.grouping(namespace).alias("_f"), F.count("*").alias("clusters"), F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias("estimated"))
    merged = merged.withColumnRenamed(namespace, "_n")
    return exact.join(merged, (F.col("_fleet") == F.col("_f")) & F.col(namespace).eqNullSafe(F.col("_n"))).select(
        namespace, (F.col("_fleet") == 1).alias("is_fleet"), "clusters", "members", "entries", "estimated")


def event_levels(events: DataFrame, ts: str, period: str, dims: list[str]) -> DataFrame:
    """Events at every level of time bucket and dimensions, from the single reason up to all events.

    ``level`` is the grouping id: a set bit, the last dimension lowest, means that the dimension is rolled up.
    """
    bucketed = events.withColumn("bucket", F.date_trunc(period, ts).cast("timestamp_ntz"))
    return bucketed.rollup("bucket", *dims).agg(
        F.grouping_id().alias("level"), F.count("*").alias("events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def event_rollup(events: DataFrame, ts: str, period: str, dims: list[str]) -> DataFrame:
    """Events per time bucket and dimension with first and last sighting."""
    return events.groupBy(F.date_trunc(period, ts).cast("timestamp_ntz").alias("bucket"), *dims).agg(
        F.count("*").alias("events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")
    )


def node_states(members: DataFrame, instances: DataFrame, key: list[str], cluster_name: str) -> DataFrame:
    """State text per address of a cluster.

    Observed instances report by address; a member without one reports by its derived name, and
    is 'unknown' without either. One row per address is the map of the cluster in long form: a
    cluster of any size never has to fit one row.
    instances: key, ``name``, ``ip`` (blank while pending), ``node_state``
    """
    has_ip = F.coalesce(F.col("ip"), F.lit("")) != ""
    by_ip = instances.where(has_ip).select(*key, "ip", "node_state")
    by_name = instances.where(~has_ip).select(*key, F.col("name").alias("_name"), F.col("node_state").alias("pending_state"))
    named = members.select(*key, "ip").distinct().withColumn("_name", instance_name(F.col(cluster_name), F.col("ip")))
    wanted = named.join(by_ip.select(*key, "ip"), [*key, "ip"], "left_anti").join(by_name, [*key, "_name"], "left")
    return by_ip.union(wanted.select(*key, "ip", F.coalesce("pending_state", F.lit("unknown")).alias("node_state")))


def all_members_ready(members: DataFrame, instances: DataFrame, key: list[str]) -> DataFrame:
    """Ready when every observed instance is ready and every wanted member is observed."""
    a = members.select(*key, "ip", F.lit(1).alias("w"), F.lit(None).cast("boolean").alias("ready"))
    b = instances.select(*key, "ip", F.lit(0).alias("w"), "ready")
    per_ip = a.union(b).groupBy(*key, "ip").agg(F.max("w").alias("w"), F.min("ready").alias("ready"))
    return per_ip.groupBy(*key).agg(
        F.sum("w").alias("desired"),
        F.count_if(F.col("ready")).alias("ready"),
        F.count_if(F.col("ready").isNotNull()).alias("observed"),
        F.count_if((F.col("w") == 1) & F.coalesce("ready", F.lit(False))).alias("desired_ready"),
    ).select(
        *key, "desired", "ready",
        ((F.col("ready") == F.col("observed")) & (F.col("desired_ready") == F.col("desired"))
         & (F.col("observed") > 0)).alias("all_ready"),
    )
