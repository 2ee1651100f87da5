"""Chunks cut by counts: equal to plain windows, spread over tasks, few scans."""

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as entry
from fleetscope.operators import chunked
from fleetscope.operators.chunked import ByCount
from fleetscope.operators.history import spec_in_force, state_intervals
from fleetscope.operators.switches import availability_switch, stuck_states

ORDER = ["ts", "n"]


@pytest.fixture(scope="module")
def history(spark):
    """One key has most of the rows, all of them within one day; values repeat, also over borders, and are null at times."""
    return spark.range(12000).selectExpr(
        "CASE WHEN id % 5 > 0 THEN 0 ELSE id % 40 END AS k", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, (id DIV 7) * 40) AS ts", "id AS n",
        "CASE WHEN id BETWEEN 3000 AND 5000 THEN 'calm' WHEN id % 9 = 0 THEN NULL ELSE elt(1 + pmod(hash(id DIV 11), 3), 'a', 'b', 'c') END AS v",
        "pmod(hash(id), 4) = 0 AS ok", "CAST(pmod(hash(id DIV 6), 4) AS INT) AS synced", "CAST(id % 3 AS INT) AS x").cache()


def chunk(rows):
    return ByCount(F.date_trunc("minute", F.col("ts")), rows)


def equal(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


@pytest.mark.parametrize("rows", [50, 700, 10**6])
def test_measures_equal_plain_windows(history, rows):
    order = [F.col(c) for c in ORDER]
    measures = dict(
        a=chunked.lag(F.col("v"), order), b=chunked.lead(F.col("v"), order), c=chunked.running_sum(F.col("x")),
        d=chunked.last_known(F.when(F.col("ok"), F.col("n")), order))
    equal(chunked.with_measures(history, ["k"], order, chunk(rows), **measures), chunked.with_measures(history, ["k"], order, None, **measures))
    equal(chunked.run_lengths(history, ["k"], order, F.col("ok"), chunk(rows)), chunked.run_lengths(history, ["k"], order, F.col("ok"), None))


@pytest.mark.parametrize("rows", [50, 700, 10**6])
def test_islands_equal_plain_windows(history, rows):
    w = Window.partitionBy("k").orderBy(*ORDER)
    plain = history.withColumns({"value": F.col("v"), "previous": F.lag("v").over(w), "first": F.row_number().over(w) == 1})
    plain = plain.where(F.col("first") | ~F.col("value").eqNullSafe(F.col("previous"))).drop("first")
    plain = plain.withColumns({"next_at": F.lead("ts").over(w), "next_value": F.lead("v").over(w)})
    equal(chunked.islands(history, ["k"], ORDER, F.col("v"), chunk(rows)), plain)
    equal(chunked.islands(history, ["k"], ORDER, F.col("v"), F.date_trunc("hour", "ts")), plain)
    equal(chunked.islands(history, ["k"], ORDER, F.col("v"), None), plain)


@pytest.mark.parametrize("rows", [50, 10**6])
def test_switches_equal_plain_ones(history, rows):
    on = (F.col("synced"), F.lit(2), 100)
    equal(availability_switch(history, ["k"], ORDER, *on, chunk(rows)), availability_switch(history, ["k"], ORDER, *on, None))
    waits = (F.col("v"), ["a", "calm"], 200)
    equal(stuck_states(history, ["k"], ORDER, *waits, chunk(rows)), stuck_states(history, ["k"], ORDER, *waits, None))
    equal(state_intervals(history, ["k"], ORDER, F.col("v"), chunk(rows)), state_intervals(history, ["k"], ORDER, F.col("v"), None))


def test_a_key_whose_rows_share_one_day_spreads(history):
    """No (key, chunk) has much more than the rows asked for, beyond one bucket."""
    islands = chunked.islands(history, ["k"], ORDER, F.col("n"), chunk(500), with_chunk=True)
    sizes = [r["count"] for r in islands.where("k = 0").groupBy("_chunk").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 600


def test_specs_of_one_time_follow_their_order(spark):
    specs = spark.createDataFrame([(1, "2024-01-01", i, f"s{i}") for i in (3, 9, 5)], "k int, t string, id int, s string")
    probes = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-01-02", 2)], "k int, t string, p int")
    got = spec_in_force(probes.withColumnRenamed("t", "at"), specs, ["k"], "at", "t", ["id", "s"], None, ["id"]).collect()
    assert {(r.p, r.s) for r in got} == {(1, "s9"), (2, "s9")}


@pytest.mark.parametrize("name, scans", [("change_points", 2), ("state_intervals", 2), ("transition_matrix", 2), ("stuck_states", 3), ("availability_switch", 4), ("event_facts", 9)])
def test_scans_of_the_history(spark, name, scans):
    """The third scan of the switches reads the times only, for the last poll of all keys; a plan may name it twice and runs it once."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= scans
