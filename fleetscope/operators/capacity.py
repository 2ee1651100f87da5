"""Storage sizes and log file retention."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantity import amount, compare, is_quantity


def percent(text: Column) -> Column:
    """``95%`` as a number; unreadable text counts as 0."""
    return F.coalesce(F.regexp_replace(text, "%", "").try_cast("double"), F.lit(0.0))


def capacity_drift(df: DataFrame, key: list[str], desired: str, actual: str) -> DataFrame:
    """Compare sizes by value, so ``1024Mi`` equals ``1Gi``; unreadable wishes need no resize."""
    order = compare(F.col(desired), F.col(actual))
    return df.select(
        *key, F.col(desired).alias("desired"), F.col(actual).alias("actual"),
        amount(F.col(desired)).cast("decimal(38,3)").alias("desired_amount"),
        F.when(order > 0, "expand").when(order < 0, "shrink").otherwise("equal").alias("change"),
        ((order != 0) & is_quantity(F.col(desired))).alias("needs_resize"),
    )


def log_retention(files: DataFrame, key: list[str], age_days: Column, gzip_days: int = 1, drop_days: int = 3) -> DataFrame:
    """Files and bytes per cluster and action. ``mtime +n`` means more than n whole days."""
    action = F.when(age_days > drop_days, "drop").when(age_days > gzip_days, "compress").otherwise("keep")
    return files.groupBy(*key, action.alias("action")).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes")
    )
