"""Synthetic accounts and transfers, the same for every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accounts(spark: SparkSession, n: int, credits: int) -> DataFrame:
    """n accounts in USD with opening credits; ids are 1, 2, ... in 16 bytes, of which the last two are used, so they repeat after 65,536."""
    i = F.col("id") + 1
    return spark.range(n).select(F.unhex(F.lpad(F.hex(i.bitwiseAND(F.lit(0xFFFF))), 32, "0")).alias("account_id"), F.lit("USD").alias("currency"), F.lit(credits).cast("long").alias("posted_credits"))
