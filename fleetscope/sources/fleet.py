"""Fleet snapshots with a declared schema."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schemas import SCHEMAS


def read_fleet(spark: SparkSession, path: str, entity: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Snapshot table of one entity; the schema is declared, so no file is read to infer it."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMAS[entity]).format(fmt).load(path)


def with_labels(df: DataFrame, labels: dict[str, str], column: str = "labels") -> DataFrame:
    """Rows whose label map holds all the given pairs."""
    for name, value in labels.items():
        df = df.where(F.col(column)[name] == value)
    return df


def members_of(specs: DataFrame, key: list[str], entries: str = "spec.ip_list") -> DataFrame:
    """Member rows of the spec with their place in the list, counted from 1."""
    return specs.select(*key, F.posexplode(entries).alias("p", "e")).select(
        *key, F.col("e.ip").alias("ip"), F.col("e.node_name").alias("node_name"),
        F.col("e.extend_ip").alias("extend_ip"), (F.col("p") + 1).alias("pos"),
    )


def remotes_of(specs: DataFrame, key: list[str], addresses: str = "spec.remote_ip_list") -> DataFrame:
    return specs.select(*key, F.posexplode(addresses).alias("p", "ip")).select(*key, "ip", (F.col("p") + 1).alias("pos"))
