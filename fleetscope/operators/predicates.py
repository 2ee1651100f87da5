"""Row predicates and labels over instance probes. A probe row carries 0/1 flag columns."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import text_hash_bucket

FLAGS = [
    "chkprocess", "chkconn", "maintenance", "pending", "primary", "standby", "standalone", "hang", "chkrepl",
]
DISCONNECTED = ["Disconnected", "Connecting..."]

# fixed values: meaning of the status codes
BUILD_TEXT = {0: "Build completed", 1: "Build failed", 2: "Building", 3: "no begin"}
BUILD_OTHER = "unknown"
JOB_TEXT = {1: "complete", 2: "failed", 3: "in process"}
JOB_OTHER = "no data"


def name_list(text: str) -> list[str]:
    """Comma-separated names, trimmed, blanks removed."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def scope_filter(df: DataFrame, column: str, include: str = "", exclude: str = "") -> DataFrame:
    """Keep the included names; without an include list drop the excluded ones.

    The lists are job options, so they become an IN filter that reaches the file scan.
    """
    wanted, unwanted = name_list(include), name_list(exclude)
    if wanted:
        return df.where(F.col(column).isin(wanted))
    if unwanted:
        return df.where(~F.col(column).isin(unwanted))
    return df


def shard_of(cols: list[Column], shards: int, width: int) -> Column:
    """Owning shard of a name; shard i owns the hash slots [i*width, (i+1)*width)."""
    if shards <= 1:
        return F.lit(0).cast("bigint")
    return F.floor(text_hash_bucket(cols, shards * width) / width).cast("bigint")


def shard_balance(df: DataFrame, cols: list[str], shards: int, width: int) -> DataFrame:
    shard = shard_of([F.col(c) for c in cols], shards, width)
    return df.groupBy(shard.alias("shard")).agg(F.count("*").alias("clusters"))


def _on(name: str) -> Column:
    return F.col(name) == 1


def needs_configure() -> Column:
    return ~_on("chkprocess") | ~_on("chkconn") | ~_on("chkrepl") | _on("pending") | _on("standalone") | _on("hang")


def is_disconnected() -> Column:
    return ~_on("chkrepl") & F.col("detailinfo").isin(DISCONNECTED)


def is_ready() -> Column:
    """Running and the database port answered."""
    return (F.col("phase") == "Running") & F.col("port_open")


def role_label() -> Column:
    return (
        F.when(_on("primary"), "Primary")
        .when(_on("standby"), "Standby")
        .when(_on("pending"), "Pending")
        .when(_on("standalone"), "Standalone")
        .otherwise("None")
    )


def label_mismatch(label: Column) -> Column:
    """Role label missing, or not the one of a primary or standby; other roles pass with any label."""
    return (
        label.isNull()
        | (_on("primary") & (label != "primary"))
        | (~_on("primary") & _on("standby") & (label != "standby"))
    )


def code_text(code: Column, texts: dict[int, str], other: str) -> Column:
    """Four fixed codes: a CASE in the same stage costs less than a join with a code table."""
    out = F.lit(other)
    for value, text in texts.items():
        out = F.when(code == value, text).otherwise(out)
    return out


def build_text(code: Column) -> Column:
    return code_text(code, BUILD_TEXT, BUILD_OTHER)


def job_text(code: Column) -> Column:
    return code_text(code, JOB_TEXT, JOB_OTHER)


def state_summary() -> Column:
    """One printable line per instance; two polls differ when their lines differ."""

    def flag(label, name):
        return F.concat(F.lit(f"{label}: "), F.when(_on(name), "true").otherwise("false"), F.lit(", "))

    detail = F.coalesce(F.col("detailinfo"), F.lit(""))
    return F.concat(
        F.lit("[Local Role: "), role_label(), F.lit(", "),
        flag("Process exist", "chkprocess"),
        flag("Connection available", "chkconn"),
        flag("DB state normal", "chkrepl"),
        flag("Maintenance", "maintenance"),
        F.lit("Build status: "), build_text(F.col("buildstatus")),
        F.lit(", Backup status: "), job_text(F.col("basebackup")),
        F.lit(", Restore status: "), job_text(F.col("restore")),
        F.lit(", Static Connections: "), F.col("connections").cast("string"), F.lit(", "),
        F.when(detail != "", F.concat(F.lit("Detail Information: "), detail, F.lit(", "))).otherwise(""),
        F.lit("]"),
    )


def idle_transactions(sessions: DataFrame, primaries: DataFrame, now: Column, hours: int, key: list[str]) -> DataFrame:
    """Sessions idle in a transaction for longer than ``hours``, on primary instances only."""
    limit = F.expr(f"INTERVAL '{int(hours)}' HOUR")
    idle = sessions.where((F.col("state") == "idle in transaction") & (F.col("state_change") < now - limit))
    return idle.join(primaries.select(*key).distinct(), key, "left_semi")
