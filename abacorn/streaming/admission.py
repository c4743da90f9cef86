"""Admission as a stream: the same fold, its state kept for each ledger, holds released on the batches' own clock."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from abacorn.operators.admission import OUTCOMES, run_batches
from abacorn.operators.fold import Account, Ledger

STATE = "ledger binary"


def admit_stream(submitted: DataFrame) -> DataFrame:
    """Outcomes of a stream of submitted rows; accounts arrive in it as rows of kind 'account' with posted_credits as amount.

    Rows of a micro-batch come in any order and are sorted by (batch_id, idx); a client batch must not span micro-batches.
    """
    columns = [c.split()[0] for c in OUTCOMES.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger: Ledger = pickle.loads(state.get[0]) if state.exists else Ledger()
        rows = pd.concat(list(frames))
        new = rows[rows["kind"] == "account"]
        for row in new.itertuples():
            ledger.accounts.setdefault(row.debit_account_id, Account("USD", int(key[0]), int(row.flags), posted_credits=int(row.amount)))
        out = list(run_batches(ledger, rows[rows["kind"] != "account"].drop(columns="kind")))
        state.update((pickle.dumps(ledger),))
        yield pd.DataFrame(out, columns=columns)

    return submitted.groupBy("ledger").applyInPandasWithState(step, OUTCOMES, STATE, "append", GroupStateTimeout.NoTimeout)


def fresh_keys(items: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """The first use of every idempotency key within the watermark, by event time; rows without a key all stay."""
    marked = items.withWatermark("event_time", ttl)
    first = marked.where(F.col("idempotency_key").isNotNull()).dropDuplicatesWithinWatermark(["idempotency_key"])
    return first.unionByName(marked.where(F.col("idempotency_key").isNull()))


def append_once(target: str, on_batch: Callable[[DataFrame, int], Any] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each epoch replaces its own partition, so a batch that is delivered again changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)
        if on_batch:
            on_batch(batch, epoch)

    return write


def fence(frames: DataFrame) -> DataFrame:
    """frames (term, arrival, ...) of the terms that were not yet superseded when they arrived."""
    from pyspark.sql import Window as W

    highest = F.max("term").over(W.partitionBy("stream").orderBy("arrival").rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("highest", highest).where(F.col("term") >= F.col("highest")).drop("highest")
