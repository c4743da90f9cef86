"""Ledger data derived from the order tables, as DataFrames and as the same common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacorn import schema as S

SINK, OPENING, EPOCH_NS = 1_000_000_000, 50_000_000, 1_700_000_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer, with opening credits, and a sink for each region."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_regionkey").cast("long").alias("ledger"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    flags = F.when(F.col("c_custkey") % 97 == 0, 1).otherwise(0) + F.when(F.col("c_custkey") % 101 == 0, 2).otherwise(0)
    credits = F.lit(OPENING) + F.greatest(F.round(F.col("c_acctbal") * 100), F.lit(0.0)).cast("long")
    people = customer.select(F.col("c_custkey").alias("account_id"), "ledger", flags.cast("long").alias("flags"), credits.alias("posted_credits"))
    sinks = table(spark, sf_dir, "region").select((F.lit(SINK) + F.col("r_regionkey")).cast("long").alias("account_id"), F.col("r_regionkey").cast("long").alias("ledger"), F.lit(0).cast("long").alias("flags"), F.lit(0).cast("long").alias("posted_credits"))
    zero = F.lit(0).cast("long")
    return people.unionByName(sinks).withColumns({"currency": F.lit("USD"), "posted_debits": zero, "pending_debits": zero, "pending_credits": zero})


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submitted transfer for each order: from the customer to its region's sink, in the order of the order's key."""
    ledgers = accounts(spark, sf_dir).select(F.col("account_id").alias("o_custkey"), "ledger")
    orders = table(spark, sf_dir, "orders").join(ledgers, "o_custkey")
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 1, "plain").when(key % 10 == 0, "void").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "full").otherwise("part")
    return orders.select(
        key.alias("transfer_id"), F.col("o_custkey").alias("debit_account_id"), (F.lit(SINK) + F.col("ledger")).alias("credit_account_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), "ledger", kind.alias("kind"), (key % 5 * 1_000_000).alias("timeout_ns"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal records: each transfer as a plain one or a hold, and for some holds a post (part or all) or a void after it."""
    t = transfers(spark, sf_dir)
    plain = F.col("kind") == "plain"
    first = t.select((F.col("transfer_id") * 2 + 1).alias("lsn"), "transfer_id", "debit_account_id", "credit_account_id", "amount", "ledger", F.when(plain, 0).otherwise(S.PENDING).cast("long").alias("flags"), F.when(plain, 0).otherwise(F.col("timeout_ns")).cast("long").alias("timeout_ns"))
    settled = t.where(F.col("kind").isin("void", "full", "part"))
    amount = F.when(F.col("kind") == "part", F.floor(F.col("amount") / 2)).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    second = settled.select((F.col("transfer_id") * 2 + 2).alias("lsn"), "transfer_id", zero.alias("debit_account_id"), zero.alias("credit_account_id"), amount.alias("amount"), "ledger", F.when(F.col("kind") == "void", S.VOID).otherwise(S.POST).cast("long").alias("flags"), zero.alias("timeout_ns"))
    return first.unionByName(second).withColumns({"ts_ns": F.lit(EPOCH_NS) + F.col("lsn") * 1000, "batch_id": F.floor(F.col("lsn") / 256)})


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submitted command for each event: batches of 100, repeated idempotency keys, linked chains."""
    e = table(spark, sf_dir, "events")
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256)
    return e.select("event_id", F.floor(F.col("event_id") / 100).alias("batch_id"), (F.col("event_id") % 100).cast("int").alias("idx"), key.alias("idempotency_key"), (F.col("event_id") % 7 == 0).alias("linked"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("amount"))


#: The same, for an engine that runs SQL over tables of these names.
SQL = f"""
f_accounts AS (
  SELECT c_custkey AS account_id, CAST(n_regionkey AS BIGINT) AS ledger,
         CAST((CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 101 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS flags,
         {OPENING} + CAST(greatest(round(c_acctbal * 100), 0) AS BIGINT) AS posted_credits
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT CAST({SINK} + r_regionkey AS BIGINT), CAST(r_regionkey AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM region),
f_transfers AS (
  SELECT o_orderkey AS transfer_id, o_custkey AS debit_account_id, {SINK} + ledger AS credit_account_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, ledger,
         CASE WHEN o_orderkey % 4 = 1 THEN 'plain' WHEN o_orderkey % 10 = 0 THEN 'void' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'full' ELSE 'part' END AS kind,
         o_orderkey % 5 * 1000000 AS timeout_ns
  FROM orders JOIN f_accounts ON account_id = o_custkey),
f_records AS (
  SELECT transfer_id * 2 + 1 AS lsn, transfer_id, debit_account_id, credit_account_id, amount, ledger, CAST(CASE WHEN kind = 'plain' THEN 0 ELSE 1 END AS BIGINT) AS flags,
         CAST(CASE WHEN kind = 'plain' THEN 0 ELSE timeout_ns END AS BIGINT) AS timeout_ns FROM f_transfers
  UNION ALL
  SELECT transfer_id * 2 + 2, transfer_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(CASE WHEN kind = 'part' THEN amount // 2 ELSE 0 END AS BIGINT), ledger,
         CAST(CASE WHEN kind = 'void' THEN 4 ELSE 2 END AS BIGINT), CAST(0 AS BIGINT) FROM f_transfers WHERE kind IN ('void', 'full', 'part')),
f_journal AS (SELECT *, {EPOCH_NS} + lsn * 1000 AS ts_ns, lsn // 256 AS batch_id FROM f_records),
f_commands AS (
  SELECT event_id, event_id // 100 AS batch_id, CAST(event_id % 100 AS INTEGER) AS idx, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)) AS idempotency_key,
         event_id % 7 = 0 AS linked, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS amount FROM events)
"""
