"""Choosing a primary, a rebuild source or a switch target by log position.

The order of candidates: highest position; then the preferred address; then, when the cluster
has recorded replication states, the lowest priority (an unlisted instance counts as 0), else
the lowest address; then the earlier one. A single candidate always wins. Among several, one
at position zero never wins unless it is the preferred one, and one whose position could not
be asked for is left out.

Every choice is a set of conditional ``min(struct)`` aggregates in one grouping, so candidates
are reduced on the map side in hash maps and a cluster of any size costs one row per task in the shuffle.

Facts of an instance (replication state, being the recorded primary) are stacked with the instances and
grouped on key and ip, which reads each history once and spreads the instances of one very large cluster
over all tasks. What a cluster's replication states say of all its members comes out of the same election
grouping. Facts of a cluster (its role) are joined only after the reduction, one row per cluster; where
they decide who may win, both elections are tallied and one is picked.

Candidate rows: key columns, ``ip``, ``pos`` (observed order), ``lsn`` (struct or NULL).
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.net import octets
from ..functions.wal import is_zero
from .hashing import group_hashed


def votes(name: str, eligible: Column, preferred: Column = None) -> list[Column]:
    """Aggregates one election needs, over the rows that meet ``eligible``."""
    preferred = F.lit(False) if preferred is None else F.coalesce(preferred, F.lit(False))
    lsn, ip = F.col("lsn"), F.col("ip")
    may_win = eligible & lsn.isNotNull() & (~is_zero(lsn) | preferred)
    rank = [
        (-lsn["left"]).alias("l"), (-lsn["middle"]).alias("m"), (-lsn["right"]).alias("r"),
        (~preferred).alias("np"),
    ]
    address = F.coalesce(octets(ip), F.lit(2**62))

    def first(cond, *order):
        return F.min(F.when(cond, F.struct(*order, F.col("pos").alias("pos"), ip.alias("ip"))))

    return [
        F.count_if(eligible).alias(f"{name}_n"),
        first(eligible).alias(f"{name}_only"),
        first(may_win, *rank, F.coalesce(F.col("priority"), F.lit(0)).alias("t")).alias(f"{name}_by_priority"),
        first(may_win, *rank, address.alias("t"), ip.alias("a")).alias(f"{name}_by_address"),
    ]


def winner(name: str, has_priorities: Column) -> Column:
    """Elected ip from the aggregates of ``votes``; NULL without a winner."""
    return F.when(F.col(f"{name}_n") == 1, F.col(f"{name}_only")["ip"]).when(
        F.col(f"{name}_n") > 1,
        F.when(has_priorities, F.col(f"{name}_by_priority")["ip"]).otherwise(F.col(f"{name}_by_address")["ip"]),
    )


def with_facts(instances: DataFrame, sync: DataFrame, clusters: DataFrame | None, key: list[str]) -> DataFrame:
    """Instances with ``seen``, ``sync_state`` and ``priority`` (``sync`` has one row per key and ip), and ``is_recorded``.

    A replication state without an instance keeps a row of its own, ``seen`` false and every instance column NULL: it
    is no candidate, but it counts among the states of its cluster. ``clusters`` adds ``is_recorded``.
    """
    rest = [c for c in instances.columns if c not in (*key, "ip")]
    blank = F.coalesce(F.col("ip"), F.lit("")) == ""
    # instances without an address have no facts; the position keeps them from meeting in one group
    stacked = instances.select(*key, "ip", F.when(blank, F.col("pos")).otherwise(0).alias("_p"), F.struct(*rest).alias("_i"))
    known = sync.where(~blank).select(*key, "ip", F.lit(0).alias("_p"), F.struct("state", "priority").alias("_s"))
    stacked = stacked.unionByName(known, allowMissingColumns=True)
    if clusters is not None:
        recorded = clusters.select(*key, F.col("recorded_primary").alias("ip"), F.lit(0).alias("_p"), F.lit(True).alias("_r")).where(~blank)
        stacked = stacked.unionByName(recorded, allowMissingColumns=True)
    else:
        stacked = stacked.withColumn("_r", F.lit(None).cast("boolean"))
    met = group_hashed(
        stacked, [*key, "ip", "_p"], F.collect_list("_i").alias("_all"), F.first("_s", ignorenulls=True).alias("_s"), F.max("_r").alias("_r")
    ).where(F.col("_s").isNotNull() | (F.size("_all") > 0))
    rows = met.select(*key, "ip", "_s", "_r", F.explode_outer("_all").alias("_i"))
    seen = F.col("_i").isNotNull()
    recorded = [] if clusters is None else [(seen & F.coalesce("_r", F.lit(False))).alias("is_recorded")]
    return rows.select(
        *key, "ip", *[F.col("_i")[c].alias(c) for c in rest], seen.alias("seen"),
        F.col("_s")["state"].alias("sync_state"), F.col("_s")["priority"].alias("priority"), *recorded,
    )


def mark_recorded(instances: DataFrame, clusters: DataFrame, key: list[str]) -> DataFrame:
    """Add ``is_recorded``: the instance is the recorded primary of its cluster."""
    recorded = clusters.select(*key, F.col("recorded_primary").alias("ip"), F.lit(True).alias("is_recorded"))
    return instances.join(recorded, [*key, "ip"], "left").withColumn("is_recorded", F.coalesce("is_recorded", F.lit(False)))


def state_flags() -> list[Column]:
    """Whether a cluster has recorded replication states, and one in state Sync."""
    return [F.max(F.col("sync_state").isNotNull()).alias("has_states"), F.max(_synced()).alias("has_sync")]


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _synced() -> Column:
    return F.coalesce(F.col("sync_state"), F.lit("")) == "Sync"


def elect_by_lsn(candidates: DataFrame, sync: DataFrame, key: list[str], preferred: Column = None) -> DataFrame:
    """Winner per cluster; clusters whose candidates all fail the rules report ``no_candidate``."""
    rows = with_facts(candidates, sync, None, key)
    tallies = group_hashed(rows, key, *votes("all", F.col("seen"), preferred), *state_flags()).where("all_n > 0")
    chosen = tallies.withColumn("winner", winner("all", _flag("has_states")))
    return chosen.select(
        *key, F.col("all_n").alias("candidates"), "winner",
        F.when(F.col("winner").isNull(), "no_candidate").otherwise("elected").alias("outcome"),
    )


def failover_choice(clusters: DataFrame, instances: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    """What to do for primary-role clusters that run without a primary, those without any observed instance included.

    clusters: key, ``local_role``, ``recorded_primary``, ``is_new``, ``role_changed``
    instances: candidate columns, ``is_primary``, ``is_standby``, ``has_repl_config``,
    ``startable`` (another role that can be started as a standby)
    """
    rows = with_facts(instances, sync, clusters, key)
    # only entries in state Sync lend a priority here
    rows = rows.withColumn("priority", F.when(_synced(), F.col("priority")))
    standby = ~F.col("is_recorded") & (F.col("is_standby") | F.col("startable"))
    tallies = group_hashed(
        rows, key, F.max("is_primary").alias("has_primary"),
        F.max(F.col("is_recorded") & F.col("has_repl_config")).alias("recorded_usable"),
        F.min(F.when(F.col("seen"), F.struct("pos", "ip"))).alias("first_seen"),
        *votes("standby", standby), *votes("synced", standby & _synced()), *state_flags(),
    )
    roles = clusters.where("local_role = 'primary'").select(*key, "recorded_primary", "is_new", "role_changed")
    chosen = roles.join(tallies, key, "left").where(~F.coalesce("has_primary", F.lit(False)))
    by_sync = _flag("has_sync") & ~F.col("is_new")
    policy = (
        F.when(F.col("recorded_usable"), "restart_recorded")
        .when(F.col("is_new"), "first_instance")
        .when(F.col("role_changed"), "elect_standby")
        .when(by_sync & (F.col("synced_n") > 0), "elect_sync_standby")
        .otherwise("no_candidate")
    )
    target = (
        F.when(policy == "restart_recorded", F.col("recorded_primary"))
        .when(policy == "first_instance", F.col("first_seen")["ip"])
        .when(policy == "elect_standby", winner("standby", by_sync))
        .when(policy == "elect_sync_standby", winner("synced", by_sync))
    )
    return chosen.select(*key, target.alias("target"), policy.alias("policy")).select(
        *key, "target",
        F.when(F.col("target").isNull(), "no_candidate").otherwise(F.col("policy")).alias("policy"),
    )


def resolve_multi_primary(clusters: DataFrame, primaries: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    """Keep one primary (recorded, else elected) and demote the rest; standby-role clusters demote all.

    clusters: key, ``local_role``, ``recorded_primary``; primaries: candidate rows in primary role
    """
    tallies = group_hashed(
        with_facts(primaries, sync, clusters, key), key, F.max("is_recorded").alias("recorded_seen"), *votes("all", F.col("seen")), *state_flags()
    ).where("all_n > 0")
    roles = clusters.select(*key, "local_role", "recorded_primary")
    chosen = tallies.join(roles, key).where((F.col("all_n") > 1) | (F.col("local_role") == "standby"))
    keep = F.when(
        F.col("local_role") == "primary",
        F.when(F.col("recorded_seen"), F.col("recorded_primary")).otherwise(winner("all", _flag("has_states"))),
    )
    verdict = chosen.select(*key, "local_role", keep.alias("keep"))
    return primaries.select(*key, "ip").join(verdict, key).select(
        *key, "ip",
        F.when(F.col("ip").eqNullSafe(F.col("keep")), "keep")
        .when(F.col("local_role") == "primary", "restart_pending")
        .otherwise("restart_standby").alias("action"),
    )


def rebuild_source(clusters: DataFrame, instances: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    """Source to copy from, for each instance with a new volume.

    Normal standbys, for primary-role clusters only those in state Sync; elected when several;
    the primary when none. instances: candidate columns, ``is_standby``, ``is_normal``, ``is_new_volume``
    """
    rows = with_facts(instances, sync, clusters, key)
    wanted = ~F.col("is_recorded") & F.col("is_new_volume")
    source = ~F.col("is_recorded") & ~F.col("is_new_volume") & F.col("is_standby") & F.col("is_normal")
    tallies = group_hashed(
        rows, key, *votes("any", source), *votes("synced", source & _synced()), *state_flags(),
        F.max(wanted).alias("wanted"), F.count_if("seen").alias("instances"),
    ).where("wanted")
    chosen = tallies.join(clusters.select(*key, "local_role", "recorded_primary"), key)
    chosen = chosen.where("local_role = 'standby' OR instances > 1")
    elected = F.when(F.col("local_role") == "standby", winner("any", _flag("has_states"))).otherwise(
        winner("synced", _flag("has_states"))
    )
    sources = chosen.select(*key, "recorded_primary", elected.alias("elected"))
    return rows.where(wanted).select(*key, "ip").join(sources, key).select(
        *key, F.col("ip").alias("target"),
        F.coalesce("elected", "recorded_primary").alias("source"),
        F.when(F.col("elected").isNull(), "primary").otherwise("standby").alias("source_kind"),
    )


def scale_in_plan(clusters: DataFrame, members: DataFrame, instances: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    """Number of instances to remove, and the new primary when the recorded one is no longer in the member list.

    members: key, ``ip``; instances: candidate columns, ``is_desired`` (address is in the member list)
    """
    desired = F.col("is_desired")
    tallies = group_hashed(
        with_facts(instances, sync, clusters, key), key, *votes("next", desired & (_synced() | F.col("is_recorded"))),
        F.count_if(~desired).alias("removals"), *state_flags(),
    ).where("removals > 0")
    listed = members.select(*key, F.col("ip").alias("recorded_primary"), F.lit(True).alias("primary_wanted")).distinct()
    recorded = clusters.select(*key, "local_role", "recorded_primary").join(listed, [*key, "recorded_primary"], "left")
    chosen = tallies.join(recorded, key)
    switch = (F.col("local_role") == "primary") & ~_flag("primary_wanted")
    elected = winner("next", _flag("has_states"))
    return chosen.select(
        *key, "removals", switch.alias("switch_primary"),
        F.when(switch, elected).when(F.col("local_role") == "primary", F.col("recorded_primary")).alias("primary_after"),
        F.when(switch & elected.isNull(), "no_candidate").otherwise("ok").alias("outcome"),
    )


def upgrade_plan(clusters: DataFrame, instances: DataFrame, sync: DataFrame, key: list[str]) -> DataFrame:
    """Steps of a rolling upgrade: mismatched standbys first, the mismatched primary last.

    The primary is switched to an elected Sync standby first, or restarted in place when there
    is none. ``stage`` orders the steps; steps of one stage follow ``pos``.
    instances: candidate columns, ``matches_spec``, ``is_primary``, ``is_standby``
    """
    rows = with_facts(instances, sync, clusters, key)
    outdated_primary = ~F.col("matches_spec") & F.col("is_primary") & ~F.col("is_standby")
    tallies = group_hashed(
        rows, key, F.max(F.when(outdated_primary, F.struct("pos", "ip"))).alias("last"),
        *votes("any", F.col("seen") & ~outdated_primary),
        *votes("synced", F.col("seen") & ~outdated_primary & (_synced() | F.col("is_recorded"))), *state_flags(),
    ).where("last IS NOT NULL")
    chosen = tallies.join(clusters.select(*key, "local_role"), key)
    standby = F.col("local_role") == "standby"
    elected = F.when(standby, winner("any", _flag("has_states"))).otherwise(winner("synced", _flag("has_states")))
    count = F.when(standby, F.col("any_n")).otherwise(F.col("synced_n"))
    primary_steps = chosen.select(
        *key, F.col("last")["ip"].alias("ip"), F.lit(2).alias("stage"), F.col("last")["pos"].alias("pos"),
        F.when(count == 0, "restart_in_place").when(elected.isNull(), "no_candidate")
        .otherwise("switch_then_upgrade").alias("step"),
        elected.alias("switch_to"),
    )
    standby_steps = instances.where(~F.col("matches_spec") & F.col("is_standby")).select(
        *key, "ip", F.lit(1).alias("stage"), "pos", F.lit("upgrade_standby").alias("step"),
        F.lit(None).cast("string").alias("switch_to"),
    )
    return standby_steps.unionByName(primary_steps)


def order_by_spec(instances: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """Sort key of each observed instance: place in the member list, then observed order.

    The key pair sorts the way the list does; ranking it would gather a cluster in one task.
    """
    known = members.select(*key, "ip", F.col("pos").alias("member_index"))
    return instances.where((F.col("ip") != "") & F.col("ip").isNotNull()).join(known, [*key, "ip"], "left").select(
        *key, "ip",
        F.when(F.col("member_index").isNull(), 1).otherwise(0).alias("outside"),
        F.coalesce("member_index", "pos").alias("place"),
    )
