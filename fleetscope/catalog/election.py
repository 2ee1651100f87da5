"""Elections and the plans built on them.

The SQL ranks candidates row by row with window functions; the operators aggregate.
"""

from pyspark.sql import functions as F

from ..operators.election import (
    elect_by_lsn, failover_choice, mark_recorded, order_by_spec, rebuild_source, resolve_multi_primary, scale_in_plan, upgrade_plan,
)
from .common import KEY, candidates, sync
from .registry import query

OCTETS = "[CAST(x AS INT) FOR x IN string_split(ip, '.')]"


def ranked(cond: str, states: str, extra: str = "", priority: str = "coalesce(priority, 0)") -> str:
    """Winner per cluster among the rows that meet ``cond``."""
    return f"""
  SELECT cluster_id, ip AS winner FROM (
    SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM ox_cand WHERE {cond}
  ) c
  WHERE n = 1 OR (ll IS NOT NULL AND (ll + lm + lr > 0{extra and f' OR {extra}'}))
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY ll DESC NULLS LAST, lm DESC, lr DESC,
    {extra and f'CASE WHEN {extra} THEN 0 ELSE 1 END,'}
    CASE WHEN {states} THEN {priority} ELSE 0 END,
    CASE WHEN {states} THEN [] ELSE {OCTETS} END, slot) = 1
"""


@query("elect_by_lsn", f"""
SELECT a.cluster_id, a.candidates, w.winner, CASE WHEN w.winner IS NULL THEN 'no_candidate' ELSE 'elected' END AS outcome
FROM (SELECT cluster_id, count(*) AS candidates FROM ox_cand WHERE f_standby = 1 GROUP BY 1) a
LEFT JOIN ({ranked('f_standby = 1', 'has_states', "ip = recorded_primary")}) w USING (cluster_id)
""")
def _(fx):
    rows = mark_recorded(candidates(fx).where("is_standby"), fx("fx_cluster"), KEY)
    return elect_by_lsn(rows, sync(fx), KEY, F.col("is_recorded"))


_standby = "(ip <> recorded_primary AND (f_standby = 1 OR f_process = 1))"
_sync_priority = "(CASE WHEN sync_state = 'Sync' THEN priority ELSE 0 END)"


@query("failover_choice", f"""
WITH none AS (
  SELECT cluster_id, any_value(recorded_primary) AS recorded_primary, any_value(is_new) AS is_new,
         any_value(role_changed) AS role_changed, any_value(has_sync) AS has_sync,
         bool_or(ip = recorded_primary AND connections > 0) AS usable, arg_min(ip, slot) AS first_ip
  FROM ox_cand WHERE local_role = 'primary' GROUP BY cluster_id HAVING NOT bool_or(f_primary = 1)
), w1 AS ({ranked(_standby, 'has_sync AND NOT is_new', priority=_sync_priority)}),
w2 AS ({ranked(_standby + " AND sync_state = 'Sync'", 'has_sync AND NOT is_new', priority=_sync_priority)}),
p AS (
  SELECT n.*, w1.winner AS x1, w2.winner AS x2,
    CASE WHEN usable THEN 'restart_recorded' WHEN is_new THEN 'first_instance' WHEN role_changed THEN 'elect_standby'
         WHEN EXISTS (SELECT 1 FROM ox_cand c WHERE c.cluster_id = n.cluster_id AND c.sync_state = 'Sync'
                      AND c.ip <> n.recorded_primary AND (f_standby = 1 OR f_process = 1)) THEN 'elect_sync_standby'
         ELSE 'no_candidate' END AS rule
  FROM none n LEFT JOIN w1 USING (cluster_id) LEFT JOIN w2 USING (cluster_id)
), t AS (
  SELECT cluster_id, rule, CASE rule WHEN 'restart_recorded' THEN recorded_primary WHEN 'first_instance' THEN first_ip
         WHEN 'elect_standby' THEN x1 WHEN 'elect_sync_standby' THEN x2 END AS target FROM p
)
SELECT cluster_id, target, CASE WHEN target IS NULL THEN 'no_candidate' ELSE rule END AS policy FROM t
UNION ALL
SELECT cluster_id, NULL, 'no_candidate' FROM fx_cluster
WHERE local_role = 'primary' AND cluster_id NOT IN (SELECT l_orderkey FROM lineitem)
""")
def _(fx):
    rows = candidates(fx).withColumns({
        "has_repl_config": F.col("connections") > 0,
        "startable": (F.col("chkprocess") == 1) & ~F.col("is_standby"),
    })
    return failover_choice(fx("fx_cluster"), rows, sync(fx), KEY)


@query("resolve_multi_primary", f"""
WITH m AS (
  SELECT cluster_id, any_value(local_role) AS role, any_value(recorded_primary) AS rec, bool_or(ip = recorded_primary) AS seen
  FROM ox_cand WHERE f_primary = 1 GROUP BY 1 HAVING count(*) > 1 OR any_value(local_role) = 'standby'
), w AS ({ranked('f_primary = 1', 'has_states')}),
k AS (SELECT m.cluster_id, role, CASE WHEN role = 'primary' THEN CASE WHEN seen THEN rec ELSE winner END END AS keep
      FROM m LEFT JOIN w USING (cluster_id))
SELECT c.cluster_id, c.ip, CASE WHEN c.ip = keep THEN 'keep' WHEN role = 'primary' THEN 'restart_pending'
       ELSE 'restart_standby' END AS action
FROM ox_cand c JOIN k USING (cluster_id) WHERE c.f_primary = 1
""")
def _(fx):
    return resolve_multi_primary(fx("fx_cluster"), candidates(fx).where("is_primary"), sync(fx), KEY)


_new = "(k1 % 6 = 0)"


@query("rebuild_source", f"""
WITH t AS (
  SELECT cluster_id, ip, recorded_primary, local_role FROM ox_cand WHERE {_new} AND ip <> recorded_primary
), n AS (SELECT cluster_id, count(*) AS n FROM ox_cand GROUP BY 1),
w AS ({ranked(f"ip <> recorded_primary AND NOT {_new} AND f_standby = 1 AND f_normal = 1 AND (local_role = 'standby' OR sync_state = 'Sync')", 'has_states')})
SELECT cluster_id, ip AS target, coalesce(winner, recorded_primary) AS source,
       CASE WHEN winner IS NULL THEN 'primary' ELSE 'standby' END AS source_kind
FROM t JOIN n USING (cluster_id) LEFT JOIN w USING (cluster_id) WHERE n.n > 1 OR local_role = 'standby'
""")
def _(fx):
    rows = candidates(fx).withColumn("is_new_volume", F.col("k1") % 6 == 0)
    return rebuild_source(fx("fx_cluster"), rows, sync(fx), KEY)


@query("scale_in_plan", f"""
WITH d AS (
  SELECT cluster_id, any_value(local_role) AS role, any_value(recorded_primary) AS rec,
         count(*) FILTER (WHERE slot > want_slots) AS removals,
         any_value(recorded_primary) IN (SELECT m.ip FROM fx_member m WHERE m.cluster_id = ox_cand.cluster_id) AS kept
  FROM ox_cand GROUP BY 1
), w AS ({ranked("slot <= want_slots AND (sync_state = 'Sync' OR ip = recorded_primary)", 'has_states')})
SELECT cluster_id, removals, role = 'primary' AND NOT kept AS switch_primary,
       CASE WHEN role = 'primary' AND NOT kept THEN winner WHEN role = 'primary' THEN rec END AS primary_after,
       CASE WHEN role = 'primary' AND NOT kept AND winner IS NULL THEN 'no_candidate' ELSE 'ok' END AS outcome
FROM d LEFT JOIN w USING (cluster_id) WHERE removals > 0
""")
def _(fx):
    wanted = fx("fx_member").select("cluster_id", "ip", F.lit(True).alias("is_desired"))
    rows = candidates(fx).join(wanted, ["cluster_id", "ip"], "left").withColumn(
        "is_desired", F.coalesce("is_desired", F.lit(False)))
    return scale_in_plan(fx("fx_cluster"), fx("fx_member"), rows, sync(fx), KEY)


_old = "(k2 % 3 = 0)"


@query("upgrade_plan", f"""
WITH l AS (
  SELECT cluster_id, arg_max(ip, slot) AS ip, max(slot) AS slot FROM ox_cand WHERE {_old} AND f_primary = 1 GROUP BY 1
), n AS (
  SELECT cluster_id, count(*) AS n FROM ox_cand
  WHERE NOT ({_old} AND f_primary = 1) AND (local_role = 'standby' OR sync_state = 'Sync' OR ip = recorded_primary) GROUP BY 1
), w AS ({ranked(f"NOT ({_old} AND f_primary = 1) AND (local_role = 'standby' OR sync_state = 'Sync' OR ip = recorded_primary)", 'has_states')})
SELECT cluster_id, ip, 1 AS stage, slot AS pos, 'upgrade_standby' AS step, NULL AS switch_to
FROM ox_cand WHERE {_old} AND f_standby = 1
UNION ALL
SELECT cluster_id, l.ip, 2, slot, CASE WHEN coalesce(n, 0) = 0 THEN 'restart_in_place' WHEN winner IS NULL THEN 'no_candidate'
       ELSE 'switch_then_upgrade' END, winner
FROM l LEFT JOIN n USING (cluster_id) LEFT JOIN w USING (cluster_id)
""")
def _(fx):
    rows = candidates(fx).withColumn("matches_spec", F.col("k2") % 3 != 0)
    return upgrade_plan(fx("fx_cluster"), rows, sync(fx), KEY)


@query("order_by_spec", """
SELECT p.cluster_id, p.ip, CASE WHEN m.slot IS NULL THEN 1 ELSE 0 END AS outside, coalesce(m.slot, p.slot) AS place
FROM ox_latest p LEFT JOIN fx_member m USING (cluster_id, ip)
WHERE phase = 'Running'
""")
def _(fx):
    seen = probes_with_ip(fx)
    return order_by_spec(seen, fx("fx_member").withColumnRenamed("slot", "pos"), KEY)


def probes_with_ip(fx):
    """Pending instances have no address yet."""
    return candidates(fx).withColumn("ip", F.when(F.col("phase") == "Running", F.col("ip")).otherwise(""))
