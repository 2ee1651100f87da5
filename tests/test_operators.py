"""Hand-computed rows, properties and skewed keys."""

import random

import pytest
from pyspark.sql import Window, functions as F

from fleetscope.functions import maps, quantity
from fleetscope.functions.hashing import text_hash_bucket
from fleetscope.functions.net import instance_name, ip_of_instance_name, is_global_unicast, octets
from fleetscope.functions.wal import position
from fleetscope.operators import chunked
from fleetscope.operators.drift import env_drift, membership_drift
from fleetscope.operators.election import elect_by_lsn
from fleetscope.operators.history import latest_snapshot
from fleetscope.operators.replication import replication_edges
from fleetscope.sources.fleet import read_fleet
from fleetscope.sources.logs import assemble_multiline, read_logs, write_logs, RECORD_START
from fleetscope.sources.probes import split_probes
from fleetscope.sources.reports import parse_replication


def column(spark, values, expr, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(got, key=lambda r: r["i"])]


def test_positions(spark):
    texts = ["0,A/1F", "x 1,2/3 4,5/6", "0/77FA8D8", "", None, "1FFFFFFFF,0/00000000ff", "G,1/2"]
    got = [None if r is None else tuple(r) for r in column(spark, texts, position)]
    assert got == [(0, 10, 31), (1, 2, 3), (0, 0, 0), (0, 0, 0), None, (4294967295, 0, 255), (0, 0, 0)]


def test_hash_wraps_and_reads_bytes(spark):
    texts = ["", "a", "ns-1cluster-7", "z" * 40, "数据库", "é" * 33, "\x7f" * 13]

    def expected(text):
        h = 0
        for b in text.encode():
            h = (31 * h + b) % 2**64
        return (2**64 - h if h >= 2**63 else h) % 48

    assert column(spark, texts, lambda c: text_hash_bucket([c], 48)) == [expected(t) for t in texts]


def test_quantities(spark):
    texts = ["500m", "0.5", "2Gi", "2048Mi", "1e3", "1k", "-1", "2X", "1 Gi", "", None, ".5G", "3u"]
    got = column(spark, texts, quantity.billionths)
    assert [None if v is None else int(v) for v in got] == [
        5 * 10**8, 5 * 10**8, 2 * 2**30 * 10**9, 2 * 2**30 * 10**9, 10**12, 10**12, -(10**9), None, None, None, None,
        5 * 10**17, 3000]
    rates = column(spark, ["2G", "1.5M", "1T", "10M"], quantity.network_rate)
    assert [int(r) for r in rates] == [2000, 2, 1000000, 10]


def test_addresses(spark):
    ips = ["10.0.0.1", "127.0.0.1", "224.0.0.1", "169.254.1.1", "256.1.1.1", "0.0.0.0", "255.255.255.255", "fd00::1",
           "::1", "fe80::1", "ff02::1", "1::2::3", "240.0.0.1", "", None, "10.0.0", "2001:db8:0:0:0:0:0:1"]
    got = column(spark, ips, lambda c: is_global_unicast("x"))
    assert got == [True, False, False, False, False, False, False, True, False, False, False, False, True, False, False,
                   False, True]
    order = column(spark, ["10.0.0.2", "10.0.0.10", "9.255.0.1", "fd00::1"], octets)
    assert order[2] < order[0] < order[1] and order[3] is None
    name = column(spark, ["10.0.0.2"], lambda c: ip_of_instance_name(instance_name(F.lit("a-pod-b"), c)))
    assert name == ["10.0.0.2"]


def test_map_rules(spark):
    df = spark.range(1).select(
        F.expr("map('a','1','b','2','gone','x')").alias("p"), F.expr("map('a','1','b','3','c','4')").alias("c"),
        F.expr("cast(null as map<string,string>)").alias("n"), F.expr("cast(map() as map<string,string>)").alias("e"))
    row = df.select(
        maps.changed(F.col("p"), F.col("c")).alias("changed"), maps.changed(F.col("n"), F.col("c")).alias("all"),
        maps.merged(F.col("p"), F.col("c")).alias("merged"), maps.merged(F.col("p"), F.col("e")).alias("none"),
        maps.differ(F.col("n"), F.col("e")).alias("differ")).first()
    assert row["changed"] == {"b": "3", "c": "4"}
    assert row["all"] == {"a": "1", "b": "3", "c": "4"}
    assert row["merged"] == {"a": "1", "b": "3", "c": "4", "gone": "x"}
    assert row["none"] == {} and row["differ"] is False


def fold(cands, states, preferred):
    """Sequential choice over candidates in order: the definition of the election."""
    if len(cands) == 1:
        return cands[0]["ip"]
    best, best_ip = (0, 0, 0), ""
    for c in cands:
        if c["lsn"] is None:
            continue
        lsn, ip = c["lsn"], c["ip"]
        if lsn > best:
            best, best_ip = lsn, ip
        elif lsn == best:
            if preferred and ip == preferred:
                best_ip = ip
            elif preferred and best_ip == preferred:
                pass
            elif states:
                if states.get(ip, 0) < states.get(best_ip, 0):
                    best_ip = ip
            elif best_ip and [int(x) for x in ip.split(".")] < [int(x) for x in best_ip.split(".")]:
                best_ip = ip
    return best_ip or None


def test_election_equals_sequential_choice(spark):
    rng = random.Random(7)
    cands, sync, expected = [], [], {}
    for k in range(1500):
        n = rng.randint(1, 6)
        ips = [f"10.0.{rng.randint(0, 1)}.{x}" for x in rng.sample(range(1, 30), n)]
        rows = [{"ip": ip, "lsn": None if rng.random() < 0.1 else tuple(rng.randint(0, 1) for _ in range(3))} for ip in ips]
        states = {ip: rng.randint(1, 2) for ip in ips if rng.random() < 0.5} if rng.random() < 0.6 else {}
        preferred = rng.choice(ips + ["", "10.9.9.9"])
        expected[k] = fold(rows, states, preferred)
        cands += [(k, c["ip"], i, c["lsn"], preferred) for i, c in enumerate(rows)]
        sync += [(k, ip, "Async", p) for ip, p in states.items()]
    # one cluster with far more instances than all others together
    big = [{"ip": f"10.{i // 250}.{i % 250}.1", "lsn": (0, i % 3, 7)} for i in range(12000)]
    expected[-1] = fold(big, {"10.47.249.1": 2}, "")
    cands += [(-1, c["ip"], i, c["lsn"], "") for i, c in enumerate(big)]
    sync.append((-1, "10.47.249.1", "Sync", 2))
    df = spark.createDataFrame(
        cands, "k int, ip string, pos int, lsn struct<left:bigint,middle:bigint,right:bigint>, preferred string")
    states = spark.createDataFrame(sync, "k int, ip string, state string, priority int")
    got = {r["k"]: r["winner"] for r in elect_by_lsn(df, states, ["k"], F.col("ip") == F.col("preferred")).collect()}
    assert got == expected


def test_replication_report(spark):
    text = """ HA state:
        local_role                     : Primary
 Senders info:
        sender_pid                     : 18133
        sync_percent                   : 100%
        sync_state                     : Sync
        sync_priority                  : 1
        channel                        : 172.16.0.5:5434-->172.16.0.2:44514
        sender_pid                     : 18134
        sync_state                     : Async
        sync_priority                  : 0
        channel                        : 172.16.0.5:5434-->172.16.0.3:44515
 Receiver info:
No information
"""
    empty = " HA state:\n local_role : Primary\n Senders info:\nNo information\n"
    df = spark.createDataFrame([(1, text), (2, empty)], "c int, t string")
    rows = sorted(tuple(r) for r in parse_replication(df, "t", ["c"]).collect())
    assert rows == [(1, "172.16.0.2", 100, "Sync", 1), (1, "172.16.0.3", 0, "Async", 0)]


def test_probes_and_quarantine(spark):
    df = spark.createDataFrame(
        [(1, '{"chkprocess":1,\n "primary":1, "detailinfo":"Normal"}'), (2, "{broken"), (3, None), (4, "")], "i int, t string")
    good, bad = split_probes(df, "t")
    row = good.first()
    assert (row["i"], row["chkprocess"], row["primary"], row["buildstatus"], row["detailinfo"]) == (1, 1, 1, 0, "Normal")
    assert sorted(r["i"] for r in bad.collect()) == [2, 3, 4]


def test_env_rules(spark):
    specs = spark.createDataFrame([(1, {"og_MONITOR_TYPE": "A", "sidecar_X": "1"})], "c int, env map<string,string>")
    inst = spark.createDataFrame(
        [(1, "og", {"MONITOR_TYPE": "A", "MY_POD_IP": "z"}), (1, "sidecar", {"X": "2", "EXTRA": "1"})],
        "c int, container string, container_env map<string,string>")
    rows = [tuple(r) for r in env_drift(inst, specs, ["c"]).collect()]
    assert rows == [(1, "sidecar", False, True, True)]


def test_lone_instance_edges(spark):
    members = spark.createDataFrame([(1, "10.0.0.1", 1)], "c int, ip string, pos int")
    remotes = spark.createDataFrame([], "c int, ip string, pos int")
    rows = {r["slot"]: (r["local_ip"], r["remote_ip"]) for r in replication_edges(members, remotes, ["c"], 5432).collect()}
    assert rows[1] == ("127.0.0.1", "127.0.0.1") and rows[2] == ("10.0.0.1", "") and len(rows) == 7


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows; times repeat."""
    return spark.range(20000).selectExpr(
        "CASE WHEN id % 3 > 0 THEN 0 ELSE id % 50 END AS k", "id DIV 2 AS t", "id AS n", "pmod(hash(id), 7) AS v",
        "pmod(hash(id, 1), 4) = 0 AS ok").cache()


def test_chunked_windows_equal_plain_windows(skewed):
    order = [F.col("t"), F.col("n")]
    w = Window.partitionBy("k").orderBy("t", "n")
    known = F.when(F.col("v") == 3, F.col("n"))
    got = chunked.with_measures(
        skewed, ["k"], order, F.floor(F.col("t") / 97),
        a=chunked.lag(F.col("v"), order), b=chunked.lead(F.col("v"), order), c=chunked.running_sum(F.col("v")),
        d=chunked.last_known(known, order))
    want = skewed.withColumns({
        "a": F.lag("v").over(w), "b": F.lead("v").over(w), "c": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "d": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    cols = ["k", "n", "a", "b", "c", "d"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.count() == want.count() == 20000


def test_chunked_runs_equal_plain_runs(skewed):
    order = [F.col("t"), F.col("n")]
    cols = ["k", "n", "run_before", "run_length"]
    got = chunked.run_lengths(skewed, ["k"], order, F.col("ok"), F.floor(F.col("t") / 5))
    want = chunked.run_lengths(skewed, ["k"], order, F.col("ok"), None)
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == 20000
    w = Window.partitionBy("k").orderBy("t", "n")
    plain = skewed.withColumn("g", F.count(F.when(F.col("ok"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = plain.withColumn("r", F.when(F.col("ok"), 0).otherwise(F.sum(F.when(~F.col("ok"), 1)).over(
        Window.partitionBy("k", "g").orderBy("t", "n").rowsBetween(Window.unboundedPreceding, 0))))
    assert got.select("n", "run_length").exceptAll(plain.select("n", F.col("r").cast("bigint"))).count() == 0


def test_hot_key_is_spread(spark, skewed):
    """The shuffle of a chunked window is keyed by (key, chunk), never by the key alone, for the large side."""
    order = [F.col("t"), F.col("n")]
    df = chunked.with_measures(skewed, ["k"], order, F.floor(F.col("t") / 97), a=chunked.lag(F.col("v"), order))
    plan = df._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "Exchange hashpartitioning(k#" in line and "_chunk" not in line and ", 4)" in line]
    assert len(alone) <= 1  # the summaries


def test_latest_is_limited_before_the_shuffle(skewed):
    df = latest_snapshot(skewed, ["k"], ["t", "n"])
    assert "partial_max" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == skewed.select("k").distinct().count()


def test_membership_ignores_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "z")], "k int, ip string")
    b = spark.createDataFrame([(1, "x"), (1, "w"), (2, "z"), (2, "z")], "k int, ip string")
    rows = {r["k"]: (r["missing"], r["beyond"], r["common"], r["equal"]) for r in membership_drift(a, b, ["k"], "ip").collect()}
    assert rows == {1: (1, 1, 1, False), 2: (0, 0, 1, True)}


def test_records_cross_chunk_borders_whole(spark):
    lines = [(1, i, f"line {i}") for i in range(25)]
    df = spark.createDataFrame(lines, "f int, s bigint, t string")
    rows = assemble_multiline(df, ["f"], "s", "t", F.col("s") == 3, 10).orderBy("record").collect()
    assert [(r["record"], r["first_seq"], r["lines"]) for r in rows] == [(0, 0, 3), (1, 3, 22)]
    assert "\n".join(r["text"] for r in rows) == "\n".join(x[2] for x in lines)


def test_log_files(spark, tmp_path):
    home = tmp_path / "logs" / "c1" / "10.0.0.1" / "archive"
    (home / "log/omm/bin/gs").mkdir(parents=True)
    (home / "log/omm/pg_log").mkdir(parents=True)
    (home / "x.audit.log").write_text("a\nb\n")
    (home / "log/omm/pg_log/p.log").write_text("c\n")
    (home / "log/omm/bin/gs/o.log").write_text("[2024-01-01 00:00:00] start\n  more\n")
    (home / "other.txt").write_text("no\n")
    lines = read_logs(spark, str(tmp_path / "logs"), stream=False)
    counts = {(r["tag"], r["cluster"], r["pod_ip"]): r["count"] for r in lines.groupBy("tag", "cluster", "pod_ip").count().collect()}
    assert counts == {("auditlog", "c1", "10.0.0.1"): 2, ("syslog", "c1", "10.0.0.1"): 1, ("omlog", "c1", "10.0.0.1"): 2}
    assert lines.where(F.col("text").rlike(RECORD_START)).count() == 1
    stamped = lines.withColumn("ts", F.lit("2024-02-03 00:00:00").cast("timestamp"))
    write_logs(stamped, "ts", str(tmp_path / "out"))
    assert (tmp_path / "out/tag=omlog/month=2024.02").is_dir()


def test_fleet_snapshot(spark, tmp_path):
    spark.sql("SELECT 'n' AS namespace, 'Secret' AS kind, 'a' AS artifact").write.parquet(str(tmp_path / "a"))
    assert read_fleet(spark, str(tmp_path / "a"), "artifact").collect()[0]["artifact"] == "a"


@pytest.mark.parametrize("name", ["latest_snapshot", "elect_by_lsn", "failover_choice", "resolve_multi_primary", "rebuild_source", "scale_in_plan", "upgrade_plan"])
def test_latest_rows_and_elections_are_grouped_in_hash_maps(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" in plan
