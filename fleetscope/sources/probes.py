"""Probe output: JSON text to flag columns."""

from pyspark.sql import DataFrame, functions as F

from .schemas import PROBE_FIELDS

_SCHEMA = ", ".join(f"{n} {t}" for n, t in PROBE_FIELDS.items()) + ", _corrupt string"


def parse_probe(df: DataFrame, text: str) -> DataFrame:
    """Add the probe fields and ``decoded``. Absent fields are 0 or blank, newlines are dropped first."""
    parsed = F.from_json(
        F.replace(F.col(text), F.lit("\n"), F.lit("")), _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = df.withColumn("_p", parsed)
    fields = [
        F.coalesce(F.col("_p")[n], F.lit("") if t == "string" else F.lit(0)).alias(n) for n, t in PROBE_FIELDS.items()
    ]
    decoded = F.col("_p").isNotNull() & F.col("_p")["_corrupt"].isNull() & (F.trim(F.col(text)) != "")
    return rows.select(*df.columns, *fields, F.coalesce(decoded, F.lit(False)).alias("decoded"))


def split_probes(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Readable probes, and the undecodable ones for the quarantine table."""
    rows = parse_probe(df, text)
    return rows.where("decoded").drop("decoded"), rows.where("NOT decoded").select(*df.columns)
