"""Ad-hoc SQL over named frames with bound parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, statement: str, frames: dict[str, DataFrame], **arguments: object) -> DataFrame:
    """Run a statement whose ``{name}`` marks are frames and whose ``:name`` marks are bound values."""
    return spark.sql(statement, args=arguments or None, **frames)


def full_scan(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Every row and column of a stored table."""
    return query(spark, "SELECT * FROM {stored}", {"stored": table})
