"""One pass over a fleet: check and fill specs, compare, judge health, decide."""

from pyspark.sql import DataFrame, functions as F

from ..operators.change import plan_action, spec_change_flags
from ..operators.defaults import apply_defaults
from ..operators.validation import valid_spec, with_violations


def decide(specs: DataFrame, health: DataFrame, key: list[str]) -> DataFrame:
    """Action per cluster.

    specs: key, ``state``, structs ``desired`` and ``applied``; health: output of cluster_health.
    An invalid spec is replaced by the applied one; an invalid new cluster is left out, since
    nothing valid exists to act on.
    """
    checked = with_violations(specs)
    bad = F.size("violations") > 0
    usable = checked.withColumn("state", F.when(bad, "invalid").otherwise(F.col("state"))).where(
        ~(bad & (F.coalesce(F.col("applied")["image"], F.lit("")) == ""))
    )
    filled = apply_defaults(usable).withColumn("desired", valid_spec())
    both = F.col("desired")["maintenance"] & F.col("applied")["maintenance"]
    modes = filled.select(*key, "state", F.coalesce(both, F.lit(False)).alias("in_maintenance"), "desired", "applied")
    # the flags are row-local, so the modes go along as further key columns
    flags = spec_change_flags(modes, [*key, "state", "in_maintenance"])
    states = flags.join(health.select(*key, "needs_reconcile"), key, "left")
    states = states.withColumn("needs_reconcile", F.coalesce("needs_reconcile", F.lit(True)))
    return plan_action(states, key)
