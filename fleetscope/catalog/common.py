"""Facts shared by the query modules."""

from pyspark.sql import DataFrame, functions as F

from ..functions.wal import position
from ..operators.history import latest_snapshot

KEY = ["cluster_id"]
FLAG_NAMES = {
    "f_process": "chkprocess", "f_conn": "chkconn", "f_maint": "maintenance", "f_pending": "pending",
    "f_primary": "primary", "f_standby": "standby", "f_standalone": "standalone", "f_hang": "hang",
    "f_normal": "chkrepl", "build_code": "buildstatus", "backup_code": "basebackup", "restore_code": "restore",
    "detail": "detailinfo",
}
# columns the row predicates and the summary line read
STATE = ["chkprocess", "chkconn", "chkrepl", "pending", "standalone", "hang"]
SUMMARY = [
    "chkprocess", "chkconn", "chkrepl", "maintenance", "primary", "standby", "pending", "standalone", "buildstatus",
    "basebackup", "restore", "connections", "detailinfo",
]
ORDER = ["probe_ts", "k1", "k2", "k3", "k4"]


def probes(fx, *columns: str) -> DataFrame:
    """Latest probe of every instance. Named columns only: what is not named is not read or sorted."""
    rows = fx("fx_probe").withColumnsRenamed(FLAG_NAMES)
    if columns:
        rows = rows.select("cluster_id", "slot", *ORDER, *[c for c in columns if c not in ORDER])
    return latest_snapshot(rows, ["cluster_id", "slot"], ORDER)


def sync(fx) -> DataFrame:
    """Latest replication state of every instance."""
    rows = fx("fx_sync").select("cluster_id", "slot", *ORDER, "ip", "state", "priority")
    return latest_snapshot(rows, ["cluster_id", "slot"], ORDER)


def candidates(fx) -> DataFrame:
    facts = ("ip", "primary", "standby", "chkrepl", "chkprocess", "connections", "phase", "lsn_text")
    return probes(fx, *facts).withColumns({
        "lsn": position(F.col("lsn_text")), "pos": F.col("slot"),
        "is_primary": F.col("primary") == 1, "is_standby": F.col("standby") == 1, "is_normal": F.col("chkrepl") == 1,
    })
