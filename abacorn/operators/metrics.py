"""Throughput, latency percentiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, value: str, percents: tuple[int, ...], by: list[str]) -> DataFrame:
    """The value at 0-based place floor(n * q / 100) of each group's sorted values, from counts of distinct values: no group is collected."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))).join(total, by)
    place = lambda q: F.floor(F.col("total") * q / 100)
    return upto.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > place(q), F.col(value))).alias(f"p{q}") for q in percents), F.max("total").alias("n"))


def linear_bucket(x: Column, start: float, width: float, count: int) -> Column:
    """Bucket of x with upper edges start, start + width, ...; count is the overflow bucket."""
    return F.least(F.greatest(F.ceil((x - start) / width), F.lit(0)), F.lit(count)).cast("int")


def exponential_bucket(x: Column, start: float, count: int) -> Column:
    """Bucket of x with upper edges start, 2 start, 4 start, ...; count is the overflow bucket."""
    edges = F.array(*(F.lit(start * 2**k) for k in range(count)))
    return F.size(F.filter(edges, lambda e: e < x)).cast("int")


def throughput(ops: Column, elapsed_ns: Column) -> Column:
    """Operations a second."""
    return F.when(elapsed_ns > 0, ops * 1_000_000_000 / elapsed_ns)


def status(code: Column) -> Column:
    """The outcome counter that an error code counts towards."""
    return F.when(code.isNull(), "success").when(code == "DuplicateTransferID", "duplicate_id").when(code == "LedgerClosed", "ledger_closed").otherwise("failed")
