"""Queries over logs, snapshots and mirrors that they write from the fixture, over replayed state, and over what clients see."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions import ledger as L
from abacorn.operators import admission, journal, metrics
from abacorn.operators.graph import shared_folder
from abacorn.plans import fixtures as X
from abacorn.plans.queries import HOLDS, LEGS, _SUBMITTED, _judged, query
from abacorn.sources import generate, mirror, snapshot, wal


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, on mounted storage, deleted when the process ends."""
    base = shared_folder(spark)
    if ":" in base and not base.startswith("file:"):
        raise RuntimeError("logs need storage that the driver and all executors mount")
    path = os.path.join("/" + base.removeprefix("file:").lstrip("/"), f"abacorn-log-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, True)
    return path


def _payload() -> dict:
    fields = ("transfer_id", "debit_account_id", "credit_account_id", "amount", "ts_ns", "timeout_ns", "ledger", "flags")
    key = F.when(F.col("flags") == 0, F.unhex(F.sha2(F.col("transfer_id").cast("string"), 256)))
    return {c: F.col(c) for c in fields} | {"idempotency_key": key, "user_data": F.when(F.col("transfer_id") % 3 > 0, F.col("transfer_id")).otherwise(0)}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The journal as log entries, after a checkpoint record in a batch of its own."""
    rows = X.journal(spark, d).select((F.col("batch_id") + 1).alias("batch_id"), F.col("lsn").alias("idx"), F.lit(S.TRANSFER).alias("type"), wal.transfer_payload(_payload()).alias("payload"))
    first = spark.range(1).select(F.lit(0).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("idx"), F.lit(S.CHECKPOINT).alias("type"), wal.checkpoint_payload(F.lit(0)).alias("payload"))
    return first.unionByName(rows)


def _log(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    spark.dataSource.register(wal.WalDataSource)
    return spark.read.format("wal").options(path=folder, **options).load()


#: LSNs as the log assigns them: the checkpoint and its commit, then every record, and a commit after each batch.
_LSN = """, g AS (SELECT *, row_number() OVER (ORDER BY lsn) + dense_rank() OVER (ORDER BY batch_id) + 1 AS placed, max(batch_id) OVER () AS final FROM f_journal)
"""


@query(
    f"{_LSN} SELECT placed AS lsn, lpad(to_hex(transfer_id), 32, '0') AS id_hex, lpad(to_hex(debit_account_id), 32, '0') AS debit_hex, lpad(to_hex(credit_account_id), 32, '0') AS credit_hex, amount, ts_ns, timeout_ns, ledger, flags FROM g WHERE batch_id < final"
)
def src03_committed_log(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01..04, SRC-11, SNK-01..03, SNK-08, SNK-15: the journal written as a binary log of several segments whose last commit is torn, read back: the last batch is hidden."""
    folder = _folder(spark)
    wal.append(_entries(spark, d), folder)
    wal.shorten(wal.segments(folder)[-1][1], 10)
    t = wal.transfers(wal.committed(_log(spark, folder)))
    hexed = (F.hex(f"{c}_id" if c == "transfer" else f"{c}_account_id").alias(n) for c, n in (("transfer", "id_hex"), ("debit", "debit_hex"), ("credit", "credit_hex")))
    return t.select("lsn", *hexed, F.col("amount").cast("long").alias("amount"), "ts_ns", F.col("timeout_ns").cast("long").alias("timeout_ns"), "ledger", "flags")


@query(
    f"""{_LSN}, b AS (SELECT max(placed) + 1 AS placed FROM g GROUP BY batch_id), f AS (SELECT placed, 1 AS type FROM g UNION ALL SELECT placed, 4 FROM b)
SELECT type, count(*) AS n, CAST(min(placed) AS BIGINT) AS low, CAST(max(placed) AS BIGINT) AS high FROM f WHERE placed > 5000 GROUP BY type"""
)
def src06_log_above(spark: SparkSession, d: str) -> DataFrame:
    """SRC-06, SRC-07, SM-04: frames above an LSN; segments that end below it are left out by their tails."""
    folder = _folder(spark)
    wal.append(_entries(spark, d), folder)
    return _log(spark, folder, from_lsn=5000).groupBy("type").agg(F.count("*").alias("n"), F.min("lsn").alias("low"), F.max("lsn").alias("high"))


@query(
    f"""{_LSN}, h AS (SELECT *, batch_id < final // 2 AS early FROM g), k AS (SELECT *, row_number() OVER (ORDER BY lsn) + dense_rank() OVER (ORDER BY batch_id) - 1 AS place FROM h WHERE NOT early)
SELECT placed AS lsn, transfer_id FROM h WHERE early UNION ALL SELECT 10000000 + place, transfer_id FROM k"""
)
def snk01_append(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, SNK-10: a second append goes on above the LSN of a snapshot that is ahead of the log."""
    folder, entries = _folder(spark), _entries(spark, d)
    half = int(X.journal(spark, d).agg(F.max("batch_id")).first()[0]) // 2
    wal.append(entries.where(F.col("batch_id") <= half), folder)
    wal.append(entries.where(F.col("batch_id") > half), folder, at_least=10_000_000)
    return wal.transfers(wal.committed(_log(spark, folder))).select("lsn", F.conv(F.hex("transfer_id"), 16, 10).cast("long").alias("transfer_id"))


_PREFIX = LEGS.replace("FROM f_journal WINDOW", "FROM f_journal WHERE lsn <= 5000 WINDOW")


@query(f"{_PREFIX} SELECT account_id, posted_debits, posted_credits, pending_debits, pending_credits, (SELECT max(ts_ns) FROM s1) AS clock_ns FROM full_state")
def st20_replay(spark: SparkSession, d: str) -> DataFrame:
    """ST-20, ST-21: a journal replayed up to an LSN: accounts and the clock, without the holds that expired by it."""
    after, state = admission.restore(X.accounts(spark, d), X.journal(spark, d).where("lsn <= 5000"))
    return after.select("account_id", "posted_debits", "posted_credits", "pending_debits", "pending_credits", F.lit(state.clock_ns).alias("clock_ns"))


@query(f"{HOLDS} SELECT transfer_id, debit_account_id, credit_account_id, \"left\", t.ledger, deadline_ns FROM holds JOIN f_transfers t USING (transfer_id, debit_account_id, credit_account_id) WHERE status = 'open'")
def st22_restored_holds(spark: SparkSession, d: str) -> DataFrame:
    """ST-22, SNK-11, SNK-13: the open holds of a snapshot that was triggered, written and read again."""
    folder = "file:" + _folder(spark)
    lsn = snapshot.trigger(X.accounts(spark, d), X.journal(spark, d), folder)
    return snapshot.read(spark, f"{folder}/snapshot-{lsn:020d}")[1].select(*admission.HOLD_COLUMNS)


@query(
    f"""{LEGS}, own AS (SELECT lsn, transfer_id, row_number() OVER (ORDER BY lsn) AS "position" FROM legs WHERE account_id = {X.SINK}), cursor AS (SELECT min("position") AS start FROM own WHERE transfer_id = (SELECT max(transfer_id) // 2 FROM own WHERE transfer_id % 2 = 0)),
v AS (SELECT transfer_id, arg_max(amount, lsn) AS amount, arg_max(flags, lsn) AS flags FROM f_journal GROUP BY 1)
SELECT transfer_id, "position", amount, flags FROM own JOIN v USING (transfer_id), cursor WHERE "position" > coalesce(start, 0) ORDER BY "position" LIMIT 50"""
)
def q04_cursor_page(spark: SparkSession, d: str) -> DataFrame:
    """Q-04: the page of one sink's history after a transfer as cursor, in the latest versions; a cursor that isn't in it starts from the beginning."""
    j = X.journal(spark, d)
    after = journal.history(j).where((F.col("account_id") == X.SINK) & (F.col("transfer_id") % 2 == 0)).agg(F.max("transfer_id")).first()[0]
    return journal.page(j, X.SINK, None if after is None else after // 2).select("transfer_id", "position", "amount", "flags")


@query(f"{LEGS} SELECT account_id, balance, available FROM full_state WHERE ledger = 1")
def q05_replica(spark: SparkSession, d: str) -> DataFrame:
    """Q-05, SRC-14, SNK-17, SNK-18: one tenant's accounts from a replica of the tables, emptied, filled and read through the mirror."""
    target = "file:" + _folder(spark)
    for name, rows in (("accounts", X.accounts(spark, d)), ("transfers", X.journal(spark, d))):
        mirror.reset(spark, rows, target, name)
        mirror.write(rows, target, name)
    accounts = mirror.read(spark, target, "accounts").where("ledger = 1")
    return journal.balances(accounts, mirror.read(spark, target, "transfers")).select("account_id", "balance", "available")


@query(
    "SELECT lower(lpad(to_hex(transfer_id), 32, '0')) AS id, lower(lpad(to_hex(debit_account_id), 32, '0')) AS debit_account_id, lower(lpad(to_hex(credit_account_id), 32, '0')) AS credit_account_id, CAST(amount AS VARCHAR) AS amount, "
    "CASE WHEN flags = 0 THEN sha256(CAST(transfer_id AS VARCHAR)) ELSE repeat('0', 64) END AS idempotency_key, flags, timeout_ns AS timeout, ts_ns AS created_at, ledger, 0 AS code, "
    "CASE WHEN transfer_id % 3 > 0 THEN lower(lpad(to_hex(transfer_id), 32, '0')) ELSE '' END AS user_data FROM f_journal"
)
def fn21_transfer_view(spark: SparkSession, d: str) -> DataFrame:
    """FN-17, FN-21, SNK-03, SRC-11: what clients see of every record, through its fixed payload and back."""
    rows = X.journal(spark, d).select("lsn", F.lit(S.TRANSFER).alias("type"), wal.transfer_payload(_payload()).alias("payload"))
    return L.transfer_view(wal.transfers(rows)).withColumn("timeout", F.col("timeout").cast("long"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN lpad(to_hex(o_orderkey), 32, '0') END AS id_hex FROM orders")
def fn15_checked_ids(spark: SparkSession, d: str) -> DataFrame:
    """FN-15: an id has exactly 16 bytes; 15 and 17 give null."""
    key = F.col("o_orderkey")
    raw = F.unhex(F.when(key % 3 == 0, F.lpad(F.hex(key), 32, "0")).when(key % 3 == 1, F.lpad(F.hex(key), 30, "0")).otherwise(F.lpad(F.hex(key), 34, "0")))
    return X.table(spark, d, "orders").select(key, F.hex(L.check_id(raw)).alias("id_hex"))


@query(
    f"{_SUBMITTED}, o AS (SELECT CASE WHEN transfer_id % 50 = 9 THEN 'duplicate_id' WHEN transfer_id % 50 = 10 THEN 'ledger_closed' WHEN error_code IS NULL THEN 'success' ELSE 'failed' END AS status FROM judged) SELECT status, count(*) AS n FROM o GROUP BY 1"
)
def ag09_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """AG-09: outcomes counted by status."""
    key = F.col("transfer_id") % 50
    code = F.when(key == 9, "DuplicateTransferID").when(key == 10, "LedgerClosed").otherwise(F.col("error_code"))
    return _judged(spark, d).groupBy(metrics.status(code).alias("status")).agg(F.count("*").alias("n"))


@query(f"{_SUBMITTED} SELECT transfer_id, CASE WHEN transfer_id % 10 = 0 THEN 'NotLeader' ELSE error_code END AS error_code FROM judged")
def adm22_follower(spark: SparkSession, d: str) -> DataFrame:
    """ADM-22: what reaches a follower is refused before any other rule."""
    return _judged(spark, d).select("transfer_id", F.coalesce(admission.role_error(F.col("transfer_id") % 10 == 0), "error_code").alias("error_code"))


@query("SELECT lpad(to_hex((range + 1) % 65536), 32, '0') AS id_hex, 'USD' AS currency, CAST(1000000 AS BIGINT) AS posted_credits FROM range(70000)")
def src20_accounts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20: synthetic accounts."""
    return generate.accounts(spark, 70_000, 1_000_000).select(F.hex("account_id").alias("id_hex"), "currency", "posted_credits")
