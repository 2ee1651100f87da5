"""Expected replication settings: connection slots, trust rules, synchronous standby names."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.net import application_name

SLOTS = 7
LOOPBACK = "127.0.0.1"
OPEN_RULES = ["host all all 0.0.0.0/0 md5", "host replication backupuser 0.0.0.0/0 md5"]


def peers(members: DataFrame, remotes: DataFrame, key: list[str]) -> DataFrame:
    """Ordinal of every address of a cluster: local ones by ``pos`` (1..n), then remote ones.

    ``pos`` counts from 1 without gaps on each side.
    """
    sizes = members.groupBy(*key).agg(F.max("pos").alias("locals"))
    local = members.select(*key, "ip", F.col("pos").cast("bigint").alias("ordinal"))
    remote = remotes.join(sizes, key).select(*key, "ip", (F.col("locals") + F.col("pos")).cast("bigint").alias("ordinal"))
    return local.union(remote)


def topology(members: DataFrame, remotes: DataFrame, key: list[str], db_port: int) -> DataFrame:
    """Every address of a cluster with its ordinal and ports: the complete expected replication, one row each.

    Slot k of the member with ordinal i points at the peer with ordinal k, or k+1 from k = i on.
    """
    return peers(members, remotes, key).select(
        *key, "ip", "ordinal", F.lit(db_port + 1).alias("data_port"), F.lit(db_port + 4).alias("service_port"),
        F.lit(db_port + 5).alias("heartbeat_port"),
    )


def replication_edges(members: DataFrame, remotes: DataFrame, key: list[str], db_port: int, slots: int = SLOTS) -> DataFrame:
    """Connection slots 1..``slots`` of every instance, blank after its last edge.

    Slot k of the i-th member points at peer k, or k+1 from its own place on, so an edge is
    looked up by ordinal and members are never paired with each other: the work is ``slots`` rows
    per instance at any cluster size. ``edges`` counts all peers, ``beyond`` those after the last
    slot; ``topology`` has every peer of a cluster once, from which each of them follows.
    """
    everyone = peers(members, remotes, key)
    sizes = everyone.groupBy(*key).agg(F.count("*").alias("peers"))
    rows = members.select(*key, "ip", "pos").join(sizes, key).select(
        *key, "ip", "pos", (F.col("peers") - 1).alias("edges"),
        F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"),
    )
    alone = (F.col("edges") == 0) & (F.col("slot") == 1)
    at = F.when(F.col("slot") <= F.col("edges"), F.col("slot") + F.when(F.col("slot") >= F.col("pos"), 1).otherwise(0))
    targets = everyone.select(*key, F.col("ordinal").alias("at"), F.col("ip").alias("peer_ip"))
    placed = rows.withColumn("at", at.cast("bigint")).join(targets, [*key, "at"], "left")
    return placed.select(
        *key, F.when(alone, LOOPBACK).otherwise(F.col("ip")).alias("local_ip"), "ip", "slot", "edges",
        F.greatest(F.col("edges") - slots, F.lit(0).cast("bigint")).alias("beyond"),
        F.when(alone, LOOPBACK).otherwise(F.coalesce("peer_ip", F.lit(""))).alias("remote_ip"),
        F.when(alone | F.col("peer_ip").isNotNull(), F.lit(db_port + 1)).otherwise(0).alias("data_port"),
        F.when(alone | F.col("peer_ip").isNotNull(), F.lit(db_port + 4)).otherwise(0).alias("service_port"),
        F.when(alone | F.col("peer_ip").isNotNull(), F.lit(db_port + 5)).otherwise(0).alias("heartbeat_port"),
    )


def edge_drift(members: DataFrame, remotes: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Per instance: edges that are right, unknown to the cluster, or missing.

    observed: key, ``ip``, ``remote_ip``. Missing ones are counted against the number of peers; a lone
    instance expects the one edge to itself.
    """
    everyone = peers(members, remotes, key)
    count = everyone.groupBy(*key).agg(F.count("*").alias("n"))
    sizes = count.select(*key, F.greatest(F.col("n") - 1, F.lit(1)).alias("expected"))
    right = everyone.select(*key, F.col("ip").alias("remote_ip")).union(count.where("n = 1").select(*key, F.lit(LOOPBACK)))
    known = observed.distinct().join(right.withColumn("k", F.lit(True)), [*key, "remote_ip"], "left").withColumn(
        "k", F.coalesce("k", F.lit(False)) & (F.col("ip") != F.col("remote_ip"))
    )
    seen = known.groupBy(*key, "ip").agg(F.count_if(F.expr("k")).alias("right"), F.count_if(~F.col("k")).alias("unexpected"))
    return members.select(*key, "ip").join(sizes, key).join(seen, [*key, "ip"], "left").select(
        *key, "ip", F.coalesce("right", F.lit(0)).alias("right"), F.coalesce("unexpected", F.lit(0)).alias("unexpected"),
        (F.col("expected") - F.coalesce("right", F.lit(0))).alias("missing"),
    )


def trust_rule(ip: Column) -> Column:
    return F.concat(F.lit("host all all "), ip, F.lit("/32 trust"))


def expected_acl(members: DataFrame, remotes: DataFrame, key: list[str]) -> DataFrame:
    """Rules of a cluster. All its instances share them, so they are not repeated per instance."""
    trusted = members.select(*key, "ip").union(remotes.select(*key, "ip")).select(*key, trust_rule(F.col("ip")).alias("rule"))
    fixed = members.select(*key).distinct().select(*key, F.explode(F.array(*[F.lit(r) for r in OPEN_RULES])).alias("rule"))
    return trusted.union(fixed).distinct()


def acl_drift(members: DataFrame, remotes: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Per instance: rules held, missing and unknown. observed: key, ``ip``, ``rule``."""
    wanted = expected_acl(members, remotes, key)
    sizes = wanted.groupBy(*key).agg(F.count("*").alias("expected"))
    matched = observed.distinct().join(wanted.withColumn("k", F.lit(True)), [*key, "rule"], "left")
    seen = matched.groupBy(*key, "ip").agg(
        F.count_if(F.col("k").isNotNull()).alias("held"), F.count_if(F.col("k").isNull()).alias("unexpected")
    )
    return members.select(*key, "ip").join(sizes, key).join(seen, [*key, "ip"], "left").select(
        *key, "ip", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("unexpected", F.lit(0)).alias("unexpected"),
        (F.col("expected") - F.coalesce("held", F.lit(0))).alias("missing"),
    )


def sync_policy(specs: DataFrame, key: list[str], local: Column, remote: Column, applied_local: Column, applied_remote: Column) -> DataFrame:
    """Synchronous standby setting of each instance: ``FIRST n(names of the others)``.

    ``local`` and ``remote`` are address arrays of the spec row, so the names are joined inside
    the row. Blank for a lone instance. The availability switch is on for a lone instance.
    """
    n_local, n_remote = F.size("l"), F.size("r")
    rows = specs.select(
        *key, F.coalesce(local, F.array().cast("array<string>")).alias("l"),
        F.coalesce(remote, F.array().cast("array<string>")).alias("r"),
        (applied_local > 1).alias("al"), (applied_remote > 0).alias("ar"),
    )
    quorum = F.when(n_remote > 0, n_local).when(n_local >= 2, F.floor(n_local / 2)).otherwise(0).cast("int")
    clustered = (n_remote > 0) | (n_local > 1)
    spread = rows.select(*key, "l", "r", "al", "ar", F.explode("l").alias("ip"))
    own = F.col("ip")
    others = F.concat(F.filter("l", lambda i: i != own), F.col("r"))
    names = F.array_join(F.transform(others, application_name), ",")
    setting = F.when(~clustered, "").when(quorum == 0, names).otherwise(
        F.concat(F.lit("FIRST "), quorum.cast("string"), F.lit("("), names, F.lit(")"))
    )
    return spread.select(
        *key, "ip", setting.alias("standby_names"),
        F.when(clustered & (F.col("al") | F.col("ar")), "OFF").otherwise("ON").alias("most_available"),
    )
