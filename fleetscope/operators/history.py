"""Snapshots and histories: latest rows, changes, intervals, transitions, runs, as-of lookups."""

from pyspark.sql import Column, DataFrame, functions as F

from .hashing import group_hashed
from .chunked import ByCount, islands, last_known, run_lengths, running_sum, with_measures


def latest_snapshot(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order`` alone; the other columns may be of any type, maps included.

    It combines on the map side in hash maps, so a hot key sends one row per task and nothing is sorted. Rows of equal
    order are one state: any of them is taken.
    """
    rest = [c for c in df.columns if c not in key]
    best = group_hashed(df, key, F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def change_points(
    df: DataFrame, key: list[str], order: list[str], value: Column, chunk: Column | ByCount | None
) -> DataFrame:
    """Rows whose value differs from the previous row of the key; the first row counts as a change."""
    return islands(df, key, order, value, chunk).drop("next_at", "next_value")


def state_intervals(
    df: DataFrame, key: list[str], order: list[str], value: Column, chunk: Column | ByCount | None
) -> DataFrame:
    """valid_from / valid_to per state; the open interval has no valid_to. ``order[0]`` is the time."""
    return islands(df.select(*dict.fromkeys([*key, *order]), value.alias("_value")), key, order, F.col("_value"), chunk).select(
        *key, "value", F.col(order[0]).alias("valid_from"), F.col("next_at").alias("valid_to"), *order[1:])


def micros(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def transition_matrix(
    df: DataFrame, key: list[str], order: list[str], value: Column, unit_us: int, chunk: Column | ByCount | None
) -> DataFrame:
    """Count of each (from, to) and the median dwell in ``from``, in whole units.

    The median is taken from counts per dwell length, so no task gathers the raw durations.
    """
    steps = islands(df.select(*dict.fromkeys([*key, *order]), value.alias("_value")), key, order, F.col("_value"), chunk).where("next_at IS NOT NULL")
    counts = steps.groupBy(
        F.col("value").alias("from_state"), F.col("next_value").alias("to_state"),
        F.floor(micros(F.col(order[0]), F.col("next_at")) / unit_us).alias("dwell"),
    ).count()
    return counts.groupBy("from_state", "to_state").agg(
        F.sum("count").alias("transitions"),
        F.percentile("dwell", F.lit(0.5), F.col("count")).alias("median_dwell"),
    )


def consecutive_failures(
    df: DataFrame, key: list[str], order: list[str], ok: Column, n: int, chunk: Column | None
) -> DataFrame:
    """The row at which a run of failures reaches ``n``; a success resets the run."""
    runs = run_lengths(df, key, [F.col(c) for c in order], ok, chunk)
    return runs.where(F.col("run_length") == n).where(~ok).drop("run_before")


def recovery_outcomes(
    df: DataFrame, key: list[str], order: list[str], recovered: Column, limit: int, chunk: Column | None
) -> DataFrame:
    """Episodes of failed checks: complete when one recovers within ``limit`` checks, else fail."""
    runs = run_lengths(df, key, [F.col(c) for c in order], recovered, chunk)
    outcome = F.when(recovered & F.col("run_before").between(1, limit), "complete").when(
        ~recovered & (F.col("run_length") == limit + 1), "fail"
    )
    tries = F.when(recovered, F.col("run_before")).otherwise(F.col("run_length"))
    return runs.select(*key, *order, outcome.alias("outcome"), tries.alias("tries")).where("outcome IS NOT NULL")


def job_outcomes(
    df: DataFrame, key: list[str], order: list[str], code: str, limit: int, chunk: Column | None
) -> DataFrame:
    """Outcome per attempt: the first 'complete' wins; not started or failed counts after ``limit`` checks."""
    ordered = [F.col(c) for c in order]
    rows = with_measures(df, key, ordered, chunk, _n=running_sum(F.lit(1).cast("bigint")))
    checks_before = F.col("_n") - 1
    terminal = F.when(F.col(code) == 1, "success").when(F.col(code).isin(0, 2) & (checks_before > limit), "fail")
    first = F.min(F.when(terminal.isNotNull(), F.struct("_n", terminal.alias("outcome"))))
    done = rows.groupBy(*key).agg(first.alias("_first"), F.count("*").alias("_checks"))
    return done.select(
        *key,
        F.coalesce(F.col("_first")["outcome"], F.lit("running")).alias("outcome"),
        F.coalesce(F.col("_first")["_n"], F.col("_checks")).alias("checks"),
    )


def build_outcomes(
    df: DataFrame, key: list[str], order: list[str], code: str, standby: Column, normal: Column, limit: int,
    chunk: Column | None,
) -> DataFrame:
    """Outcome of a rebuild: waits while building; then a failed code fails, a normal standby
    succeeds, and a completed build that never gets normal is taken after ``limit`` more waits."""
    ordered = [F.col(c) for c in order]
    idle = F.when(F.col(code) != 2, 1).otherwise(0).cast("bigint")
    rows = with_measures(
        df, key, ordered, chunk, _n=running_sum(F.lit(1).cast("bigint")), _idle=running_sum(idle)
    )
    waits = F.col("_idle") - 1
    terminal = (
        F.when(F.col(code) == 1, "fail")
        .when((F.col(code) == 0) & standby & normal, "success")
        .when((F.col(code) == 0) & ~normal & (waits > limit), "success_not_normal")
    )
    first = F.min(F.when(terminal.isNotNull(), F.struct("_n", terminal.alias("outcome"))))
    done = rows.groupBy(*key).agg(first.alias("_first"), F.count("*").alias("_checks"))
    return done.select(
        *key,
        F.coalesce(F.col("_first")["outcome"], F.lit("running")).alias("outcome"),
        F.coalesce(F.col("_first")["_n"], F.col("_checks")).alias("checks"),
    )


def spec_in_force(
    probes: DataFrame, specs: DataFrame, key: list[str], probe_ts: str, spec_ts: str, spec_cols: list[str],
    chunk_of, tie: list[str] = (),
) -> DataFrame:
    """Each probe with the latest spec at or before it; of specs of one time the last by ``tie`` (columns of the spec).

    Both sides are stacked and the last spec is carried forward along the time, which reads
    each side once and never pairs a probe with more than one spec.
    """
    payload = [c for c in probes.columns if c not in key and c != probe_ts]
    spec_type = F.struct(F.col(spec_ts).alias("spec_ts"), *[F.col(c) for c in spec_cols])
    left = probes.select(
        *key, F.col(probe_ts).alias("_at"), F.lit(1).alias("_side"), F.struct(*payload).alias("_probe")
    )
    right = specs.select(
        *key, F.col(spec_ts).alias("_at"), F.lit(0).alias("_side"), spec_type.alias("_spec")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    order = [F.col("_at"), F.col("_side"), *[F.col("_spec")[c] for c in tie]]
    seen = with_measures(
        both, key, order, None if chunk_of is None else chunk_of(F.col("_at")),
        _in_force=last_known(F.col("_spec"), order),
    )
    return seen.where(F.col("_side") == 1).select(
        *key,
        F.col("_at").alias(probe_ts),
        *[F.col("_probe")[c].alias(c) for c in payload],
        F.col("_in_force")["spec_ts"].alias("spec_ts"),
        *[F.col("_in_force")[c].alias(c) for c in spec_cols],
    )


def sync_by_priority(df: DataFrame, key: list[str], tie: list[str], chunk: Column | None) -> DataFrame:
    """Position of each replication row within its cluster, ascending by priority."""
    order = [F.col("priority"), *[F.col(c) for c in tie]]
    return with_measures(df, key, order, chunk, position=running_sum(F.lit(1).cast("bigint")))


def fullest_volumes(df: DataFrame, usage: Column, tie: list[str], k: int) -> DataFrame:
    return df.withColumn("usage", usage).orderBy(F.col("usage").desc(), *tie).limit(k)
