"""The alert table every detector writes to, and the catalog of its reasons."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: reason and type of each alert, with the message it carries
REASONS = [
    ("Creating", "Normal", "create cluster"),
    ("Updating", "Normal", "update cluster"),
    ("Recorvering", "Warning", "recover cluster"),
    ("restoring", "Normal", "restore data from file %s"),
    ("Ready", "Normal", "cluster is healthy"),
    ("MaintainStart", "Normal", "maintenance started"),
    ("MaintainComplete", "Normal", "maintenance ended"),
    ("Failed", "Warning", "failure: %s"),
    ("ValidateFail", "Warning", "spec check failed: %s"),
    ("ValidateFix", "Normal", "spec corrected"),
    ("SetPrimary", "Normal", "instance %s set as primary"),
    ("SetStandby", "Normal", "instance %s set as standby"),
    ("SwitchPrimary", "Normal", "primary switched to %s"),
    ("ConfigDBFail", "Warning", "instance %s not configured"),
    ("RestoreFail", "Warning", "restore on instance %s failed"),
    ("BasebackupFail", "Warning", "copy to instance %s failed"),
    ("PodBuildFail", "Warning", "rebuild of instance %s failed"),
    ("PodBuildComplete", "Normal", "rebuild of instance %s complete"),
    ("FixStandbyComplete", "Normal", "instance %s repaired"),
    ("FixStandbyFail", "Warning", "repair of instance %s failed"),
    ("DeleteInstance", "Normal", "instance %s removed"),
    ("UpgradeInstance", "Normal", "instance %s upgraded"),
    ("InstanceStartTimeout", "Warning", "instance %s did not start in time"),
    ("SetMostAvailable", "Normal", "availability mode set to %s"),
    ("SetDefaultTransaction", "Normal", "storage threshold reached, read-only set to %s"),
    ("StartPodFail", "Warning", "instance %s did not start"),
    ("ServiceFail", "Warning", "service %s failed"),
]


def reason_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASONS, "reason string, type string, template string")


def facts(df: DataFrame, key: list[str], ts: Column, reason: str, subject: Column) -> DataFrame:
    """Rows of one detector in the shape of the alert table, before type and message."""
    return df.select(
        *key, ts.alias("ts"), F.lit(reason).alias("reason"),
        F.coalesce(subject.cast("string"), F.lit("unknown")).alias("subject"),
    )


def event_facts(spark: SparkSession, detections: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of detector rows with type and message. The catalog is a constant of 27 rows, hence broadcast.

    A reason that the catalog does not have is a warning whose message is reason and subject.
    """
    rows = detections[0]
    for d in detections[1:]:
        rows = rows.unionByName(d)
    typed = rows.join(F.broadcast(reason_catalog(spark)), "reason", "left")
    message = F.replace(F.coalesce("template", F.concat("reason", F.lit(": %s"))), F.lit("%s"), F.col("subject"))
    return typed.select(*key, "ts", F.coalesce("type", F.lit("Warning")).alias("type"), "reason", message.alias("message"))
