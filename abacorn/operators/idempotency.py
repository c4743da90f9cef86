"""Idempotent ingestion: the first use of a key counts, later ones get the original."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_batch_conflicts(items: DataFrame) -> DataFrame:
    """items (batch_id, idx, idempotency_key) with conflict: the key was used earlier in the same client batch. Rows without a key never are."""
    nth = F.row_number().over(W.partitionBy("batch_id", "idempotency_key").orderBy("idx"))
    return items.withColumn("conflict", F.col("idempotency_key").isNotNull() & (nth > 1))


def first_use(items: DataFrame) -> DataFrame:
    """items (event_id, idempotency_key) with original_id, the first row of their key, and is_first."""
    firsts = items.where(F.col("idempotency_key").isNotNull()).groupBy("idempotency_key").agg(F.min("event_id").alias("original_id"))
    out = items.join(firsts, "idempotency_key", "left").withColumn("original_id", F.coalesce("original_id", "event_id"))
    return out.withColumn("is_first", F.col("event_id") == F.col("original_id"))


def first_success(items: DataFrame) -> DataFrame:
    """items (event_id, idempotency_key, ok) with original_id, the first successful row of their key: a failure frees the key."""
    firsts = items.where("ok and idempotency_key is not null").groupBy("idempotency_key").agg(F.min("event_id").alias("original_id"))
    later = F.col("event_id") > F.col("original_id")
    return items.join(firsts, "idempotency_key", "left").withColumn("replayed", F.coalesce(later, F.lit(False)))


def within_ttl(items: DataFrame, ttl_us: int) -> DataFrame:
    """items (event_id, idempotency_key, ts_us) with fresh: no earlier use of the key is remembered. Rows without a key are always fresh.

    A key is remembered from the use that was fresh until its time to live is over; a repeat in between doesn't prolong it. A key's uses pass by in
    order, sorted on disk where they are many; only the last fresh one is held.
    """
    keyed = items.where(F.col("idempotency_key").isNotNull() & F.col("ts_us").isNotNull()).select("idempotency_key", F.col("ts_us").cast("long").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, since = None, 0
        for batch in batches:
            fresh = []
            for own, at in zip(batch.column("idempotency_key").to_pylist(), batch.column("ts_us").to_pylist()):
                new = own != key or at - since > ttl_us
                if new:
                    key, since = own, at
                fresh.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(fresh, pa.bool_())], ["event_id", "fresh"])

    ordered = keyed.repartition("idempotency_key").sortWithinPartitions("idempotency_key", "ts_us", "event_id")
    judged = ordered.mapInArrow(fold, "event_id long, fresh boolean")
    return items.join(judged, "event_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
