"""The relational mirror: accounts and transfers as tables, over JDBC or as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write(df: DataFrame, target: str, table: str, properties: dict | None = None) -> None:
    """Append to a JDBC table (target starting with jdbc:) or to the Parquet folder target/table."""
    if target.startswith("jdbc:"):
        df.write.jdbc(target, table, mode="append", properties=properties or {})
    else:
        df.write.mode("append").parquet(f"{target}/{table}")


def read(spark: SparkSession, target: str, table: str, properties: dict | None = None) -> DataFrame:
    return spark.read.jdbc(target, table, properties=properties or {}) if target.startswith("jdbc:") else spark.read.parquet(f"{target}/{table}")


def reset(spark: SparkSession, df: DataFrame, target: str, table: str, properties: dict | None = None) -> None:
    """Create or empty a table of df's schema."""
    nothing = spark.createDataFrame([], df.schema)
    if target.startswith("jdbc:"):
        nothing.write.option("truncate", True).jdbc(target, table, mode="overwrite", properties=properties or {})
    else:
        nothing.write.mode("overwrite").parquet(f"{target}/{table}")
