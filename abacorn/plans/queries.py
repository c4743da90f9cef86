
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions import ledger as L
from abacorn.functions import money as M
from abacorn.operators import admission, audit, idempotency, journal, metrics
from abacorn.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register the function under its name; sql: the same query, with the fixture's common table expressions before it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {X.SQL}{sql}"
        return f

    return register


#: Settled records and legs, as SQL: left before each post or void, amounts moved, accounts of the hold.
LEGS = """, s1 AS (
  SELECT *, max(CASE WHEN flags = 1 THEN amount END) OVER i AS hold_amount, max(CASE WHEN flags = 1 THEN debit_account_id END) OVER i AS hold_debit,
         max(CASE WHEN flags = 1 THEN credit_account_id END) OVER i AS hold_credit FROM f_journal WINDOW i AS (PARTITION BY transfer_id)),
s2 AS (SELECT *, CASE WHEN flags IN (2, 4) THEN hold_debit ELSE debit_account_id END AS debit, CASE WHEN flags IN (2, 4) THEN hold_credit ELSE credit_account_id END AS credit,
  CASE WHEN flags = 2 THEN CASE WHEN amount = 0 THEN hold_amount ELSE amount END WHEN flags IN (1, 4) THEN 0 ELSE amount END AS posted,
  CASE WHEN flags = 1 THEN amount WHEN flags = 2 THEN -CASE WHEN amount = 0 THEN hold_amount ELSE amount END WHEN flags = 4 THEN -hold_amount ELSE 0 END AS pending FROM s1),
legs AS (SELECT lsn, transfer_id, ledger, ts_ns, debit AS account_id, 'debit' AS side, posted AS posted_debits, 0 AS posted_credits, pending AS pending_debits, 0 AS pending_credits FROM s2
  UNION ALL SELECT lsn, transfer_id, ledger, ts_ns, credit, 'credit', 0, posted, 0, pending FROM s2),
gone AS (SELECT max(hold_debit) AS d, max(hold_credit) AS c, sum(pending) AS rest FROM s2 WHERE hold_amount IS NOT NULL GROUP BY transfer_id
  HAVING max(CASE WHEN flags = 1 AND timeout_ns > 0 THEN ts_ns + timeout_ns END) <= (SELECT max(ts_ns) FROM s1) AND sum(pending) > 0),
changes AS (SELECT account_id, posted_debits, posted_credits, pending_debits, pending_credits FROM legs UNION ALL SELECT d, 0, 0, -rest, 0 FROM gone UNION ALL SELECT c, 0, 0, 0, -rest FROM gone),
moved AS (SELECT account_id, sum(posted_debits) AS d, sum(posted_credits) AS c, sum(pending_debits) AS nd, sum(pending_credits) AS nc FROM changes GROUP BY 1),
state AS (SELECT a.account_id, a.ledger, a.flags, a.posted_credits AS opening, CAST(coalesce(d, 0) AS BIGINT) AS posted_debits, CAST(a.posted_credits + coalesce(c, 0) AS BIGINT) AS posted_credits,
  CAST(coalesce(nd, 0) AS BIGINT) AS pending_debits, CAST(coalesce(nc, 0) AS BIGINT) AS pending_credits FROM f_accounts a LEFT JOIN moved USING (account_id)),
full_state AS (SELECT *, CASE WHEN posted_credits >= posted_debits THEN posted_credits - posted_debits END AS balance,
  CASE WHEN posted_credits >= posted_debits AND posted_credits - posted_debits >= pending_debits THEN posted_credits - posted_debits - pending_debits + pending_credits END AS available FROM state)
"""
HOLDS = """, h AS (SELECT transfer_id, max(CASE WHEN flags = 1 THEN amount END) AS hold_amount, max(CASE WHEN flags = 1 THEN debit_account_id END) AS debit_account_id,
  max(CASE WHEN flags = 1 THEN credit_account_id END) AS credit_account_id, max(CASE WHEN flags = 1 AND timeout_ns > 0 THEN ts_ns + timeout_ns END) AS deadline_ns,
  sum(CASE WHEN flags = 2 THEN amount ELSE 0 END) AS part, max(CASE WHEN flags = 2 AND amount = 0 THEN 1 ELSE 0 END) AS whole, max(CASE WHEN flags = 4 THEN 1 ELSE 0 END) AS voided
  FROM f_journal WHERE flags <> 0 GROUP BY 1),
h2 AS (SELECT *, CAST(CASE WHEN whole = 1 OR voided = 1 THEN 0 ELSE hold_amount - part END AS BIGINT) AS "left", (SELECT max(ts_ns) FROM f_journal) AS clock FROM h),
holds AS (SELECT transfer_id, debit_account_id, credit_account_id, hold_amount, "left", deadline_ns,
  CASE WHEN voided = 1 THEN 'voided' WHEN "left" = 0 THEN 'posted' WHEN deadline_ns <= clock THEN 'expired' ELSE 'open' END AS status FROM h2)
"""
STATE_COLUMNS = ["account_id", "ledger", "posted_debits", "posted_credits", "pending_debits", "pending_credits", "balance", "available"]


def _state(spark: SparkSession, d: str) -> DataFrame:
    return journal.balances(X.accounts(spark, d), X.journal(spark, d))


@query(f"{LEGS} SELECT account_id, ledger, posted_debits, posted_credits, pending_debits, pending_credits, balance, available FROM full_state")
def st02_balances(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every account's state, balance and available balance after the journal (ST-02..05, AG-01, Q-06)."""
    return _state(spark, d).select(*STATE_COLUMNS)


@query(f"{LEGS} SELECT account_id, CASE WHEN balance IS NULL OR available IS NULL THEN 'InvariantViolation' END AS error_code, (flags & 1) <> 0 AS frozen, (flags & 2) <> 0 AS closed FROM full_state")
def fn10_account_view(spark: SparkSession, d: str) -> DataFrame:
    """FN-10..12, FN-20: derived balances with their error, frozen, closed."""
    return _state(spark, d).select("account_id", "error_code", L.is_frozen(F.col("flags")).alias("frozen"), L.is_closed(F.col("flags")).alias("closed"))


@query(
    "SELECT transfer_id, CAST(amount + timeout_ns AS BIGINT) AS total, CASE WHEN amount >= timeout_ns * 10 THEN amount - timeout_ns * 10 END AS rest, "
    "CASE WHEN amount < timeout_ns THEN -1 WHEN amount > timeout_ns THEN 1 ELSE 0 END AS cmp, timeout_ns = 0 AS is_zero, amount * 3 AS tripled FROM f_transfers"
)
def fn01_money(spark: SparkSession, d: str) -> DataFrame:
    """FN-01..05, FN-09: checked arithmetic."""
    a, b = F.col("amount"), F.col("timeout_ns")
    return X.transfers(spark, d).select("transfer_id", M.add(a, b).cast("long").alias("total"), M.subtract(a, b * 10).cast("long").alias("rest"), M.compare(a, b).alias("cmp"), (b == 0).alias("is_zero"), M.multiply(a, F.lit(3)).cast("long").alias("tripled"))


@query(
    ", t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '00' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '-' || CAST(o_orderkey AS VARCHAR) WHEN 2 THEN '' WHEN 3 THEN repeat('9', 30) || CAST(o_orderkey % 10 AS VARCHAR) ELSE repeat('9', 39) END AS s FROM orders) "
    "SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[0-9]+') AND length(ltrim(s, '0')) <= 38 THEN coalesce(nullif(ltrim(s, '0'), ''), '0') END AS parsed FROM t"
)
def fn06_parse(spark: SparkSession, d: str) -> DataFrame:
    """FN-06, FN-07: text to money and back; signs, empty text and more than 38 digits give null."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    s = F.when(key % 5 == 0, F.concat(F.lit("00"), text)).when(key % 5 == 1, F.concat(F.lit("-"), text)).when(key % 5 == 2, "").when(key % 5 == 3, F.concat(F.lit("9" * 30), (key % 10).cast("string"))).otherwise("9" * 39)
    return X.table(spark, d, "orders").select("o_orderkey", M.show(M.parse(s)).alias("parsed"))


@query("SELECT transfer_id, lpad(to_hex(amount), 32, '0') AS hex16, CAST(amount AS VARCHAR) AS back FROM f_transfers")
def fn08_binary(spark: SparkSession, d: str) -> DataFrame:
    """FN-08: 16 big-endian bytes and back, through the exact form."""
    b = M.exact_to_binary(M.exact(F.lit(0), F.col("amount")))
    return X.transfers(spark, d).select("transfer_id", F.lower(F.hex(b)).alias("hex16"), M.show(M.to_money(M.exact_from_binary(b))).alias("back")).withColumn("hex16", F.upper("hex16"))


@query("SELECT event_id, upper(sha256(props)) AS key_hex, left(event_type, 4) AS currency, length(props) = 32 AS raw FROM events")
def fn18_keys(spark: SparkSession, d: str) -> DataFrame:
    """FN-18, FN-19: key normalisation and the four-byte currency."""
    e = X.table(spark, d, "events")
    return e.select("event_id", F.hex(L.idempotency_key(F.col("props"))).alias("key_hex"), L.currency(F.col("event_type")).alias("currency"), (F.octet_length("props") == 32).alias("raw"))


@query(
    ", t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0x' || lpad(to_hex(o_orderkey), 32, '0') WHEN 1 THEN lpad(to_hex(o_orderkey), 32, '0') ELSE 'x' || CAST(o_orderkey AS VARCHAR) END AS s FROM orders) "
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN right(upper(s), 32) END AS id_hex, CASE WHEN o_orderkey % 3 < 2 THEN right(upper(s), 32) ELSE rpad(hex(s), 32, '0') END AS user_data_hex FROM t"
)
def fn14_ids(spark: SparkSession, d: str) -> DataFrame:
    """FN-14..17: ids from hex text, user data as bytes."""
    key = F.col("o_orderkey")
    digits = F.lpad(F.hex(key), 32, "0")
    s = F.when(key % 3 == 0, F.concat(F.lit("0x"), digits)).when(key % 3 == 1, digits).otherwise(F.concat(F.lit("x"), key.cast("string")))
    return X.table(spark, d, "orders").select("o_orderkey", F.hex(L.parse_id(s)).alias("id_hex"), F.hex(L.parse_user_data(s)).alias("user_data_hex"))


@query("SELECT lsn, CASE WHEN timeout_ns > 0 THEN ts_ns + timeout_ns END AS deadline_ns, (flags & 1) <> 0 AS pending, (flags & 2) <> 0 AS post, (flags & 4) <> 0 AS void, (flags & 8) <> 0 AS linked, flags > 15 AS unknown FROM f_journal")
def fn13_flags(spark: SparkSession, d: str) -> DataFrame:
    """FN-13, FN-23: flag tests and hold deadlines."""
    f = F.col("flags")
    bits = (L.has(f, b).alias(n) for b, n in ((S.PENDING, "pending"), (S.POST, "post"), (S.VOID, "void"), (S.LINKED, "linked")))
    return X.journal(spark, d).select("lsn", L.deadline(F.col("ts_ns"), F.col("timeout_ns")).cast("long").alias("deadline_ns"), *bits, L.unknown_flags(f).alias("unknown"))


@query()
def fn22_crc32(spark: SparkSession, d: str) -> DataFrame:
    """FN-22: CRC-32 of a binary value."""
    return X.table(spark, d, "events").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


_SUBMITTED = """, submitted AS (SELECT transfer_id, CASE WHEN transfer_id % 50 = 3 THEN -1 WHEN transfer_id % 50 = 4 THEN credit_account_id ELSE debit_account_id END AS debit_account_id, credit_account_id,
  CASE WHEN transfer_id % 50 = 5 THEN 0 ELSE amount END AS amount, CASE WHEN transfer_id % 50 = 6 THEN ledger + 1 ELSE ledger END AS ledger,
  CAST(CASE WHEN transfer_id % 50 = 7 THEN 16 WHEN transfer_id % 50 = 8 THEN 3 WHEN transfer_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS flags FROM f_transfers),
judged AS (SELECT t.transfer_id, CASE WHEN t.flags > 15 OR t.flags = 3 THEN 'InvalidTransferFlags' WHEN t.amount = 0 THEN 'ZeroAmount' WHEN t.debit_account_id = t.credit_account_id THEN 'SelfTransfer'
  WHEN a.account_id IS NULL OR b.account_id IS NULL THEN 'AccountNotFound' WHEN a.ledger <> t.ledger OR b.ledger <> t.ledger THEN 'LedgerMismatch'
  WHEN a.flags & 1 <> 0 THEN 'AccountFrozen' WHEN a.flags & 2 <> 0 THEN 'AccountClosed' WHEN b.flags & 1 <> 0 THEN 'AccountFrozen' WHEN b.flags & 2 <> 0 THEN 'AccountClosed' END AS error_code
  FROM submitted t LEFT JOIN f_accounts a ON a.account_id = t.debit_account_id LEFT JOIN f_accounts b ON b.account_id = t.credit_account_id)
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("transfer_id") % 50
    t = X.transfers(spark, d).withColumns(
        {
            "debit_account_id": F.when(key == 3, -1).when(key == 4, F.col("credit_account_id")).otherwise(F.col("debit_account_id")),
            "amount": F.when(key == 5, 0).otherwise(F.col("amount")),
            "ledger": F.when(key == 6, F.col("ledger") + 1).otherwise(F.col("ledger")),
            "flags": F.when(key == 7, 16).when(key == 8, 3).when(key % 2 == 0, 1).otherwise(0).cast("long"),
        }
    )
    return admission.static_error(t, X.accounts(spark, d))


@query(f"{_SUBMITTED} SELECT transfer_id, error_code FROM judged")
def adm01_static_rules(spark: SparkSession, d: str) -> DataFrame:
    """ADM-01, 02, 10..15: the first stateless rule that a submitted transfer breaks."""
    return _judged(spark, d).select("transfer_id", "error_code")


@query(f"{_SUBMITTED}, e AS (SELECT * FROM (VALUES {', '.join(f'({e[0]!r}, {e[1]}, {e[2]!r}, {e[3]!r})' for e in S.ERRORS)}) v(code, http, grpc, template)) SELECT error_code, http AS http_status, grpc AS grpc_status, count(*) AS n FROM judged JOIN e ON code = error_code GROUP BY 1, 2, 3")
def fn24_statuses(spark: SparkSession, d: str) -> DataFrame:
    """FN-24, FN-25, AG-09: errors by HTTP and gRPC status."""
    code = F.col("error_code")
    return _judged(spark, d).where(code.isNotNull()).groupBy(code, S.lookup(code, 1).cast("int").alias("http_status"), S.lookup(code, 2).alias("grpc_status")).agg(F.count("*").alias("n"))


@query(f"{_SUBMITTED}, e AS (SELECT * FROM (VALUES {', '.join(f'({e[0]!r}, {e[3]!r})' for e in S.ERRORS)}) v(code, template)) SELECT transfer_id, replace(template, '%s', CAST(transfer_id AS VARCHAR)) AS detail FROM judged JOIN e ON code = error_code")
def fn26_details(spark: SparkSession, d: str) -> DataFrame:
    """FN-26: detail texts of errors."""
    bad = _judged(spark, d).where("error_code is not null")
    return bad.select("transfer_id", L.detail(F.col("error_code"), F.col("transfer_id")).alias("detail"))


@query(
    ", n AS (SELECT (SELECT max(c_custkey) FROM customer) // 2 + c_custkey // 2 AS account_id, c_custkey // 100 AS batch_id, CAST(c_custkey % 100 AS INTEGER) AS idx, CASE WHEN c_custkey % 11 = 0 THEN 10 ELSE 0 END AS posted_debits, 5 AS posted_credits FROM customer), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY account_id, posted_debits <= posted_credits ORDER BY batch_id, idx) AS nth FROM n) "
    "SELECT k.batch_id, k.idx, k.account_id, CASE WHEN k.posted_debits > k.posted_credits THEN 'InvariantViolation' WHEN nth > 1 OR f.account_id IS NOT NULL THEN 'DuplicateAccountID' END AS error_code FROM k LEFT JOIN f_accounts f ON f.account_id = k.account_id"
)
def adm19_account_create(spark: SparkSession, d: str) -> DataFrame:
    """ADM-19, ADM-20, ST-01, ST-23: accounts that may be created, half of them with ids of existing ones. The joined maximum is one row."""
    c = X.table(spark, d, "customer")
    key = F.col("c_custkey")
    top = c.agg(F.max("c_custkey").alias("top"))
    new = c.crossJoin(F.broadcast(top)).select((F.floor(F.col("top") / 2) + F.floor(key / 2)).alias("account_id"), F.floor(key / 100).alias("batch_id"), (key % 100).cast("int").alias("idx"), F.when(key % 11 == 0, 10).otherwise(0).alias("posted_debits"), F.lit(5).alias("posted_credits"))
    return admission.create_errors(new, X.accounts(spark, d)).select("batch_id", "idx", "account_id", "error_code")


@query("SELECT event_id // 9000 AS batch_id, count(*) AS items, CASE WHEN count(*) > 8192 THEN 'BatchTooLarge' END AS error_code FROM events GROUP BY 1")
def adm21_batch_limit(spark: SparkSession, d: str) -> DataFrame:
    """ADM-21: client batches beyond the limit."""
    return admission.batch_errors(X.table(spark, d, "events").select(F.floor(F.col("event_id") / 9000).alias("batch_id")))


_OUTCOMES = """, fold AS (SELECT debit_account_id, any_value(a.posted_credits) AS opening, list(amount ORDER BY transfer_id) AS amounts, list(transfer_id ORDER BY transfer_id) AS ids FROM f_transfers JOIN f_accounts a ON a.account_id = debit_account_id GROUP BY 1),
folded AS (SELECT debit_account_id, list_reduce(amounts, lambda a, x: CASE WHEN a >= x THEN a - x ELSE a END, opening) AS rest FROM fold)
"""


@query(f'{_OUTCOMES} SELECT debit_account_id, CAST(rest AS BIGINT) AS "left" FROM folded')
def adm17_restricted_fold(spark: SparkSession, d: str) -> DataFrame:
    """ADM-17 where sinks never debit: funds left of every account after the ordered fold, in the JVM."""
    opening = X.accounts(spark, d).select(F.col("account_id").alias("debit_account_id"), F.col("posted_credits").alias("opening"))
    t = X.transfers(spark, d).join(opening, "debit_account_id")
    return admission.admit_to_sinks(t, F.col("opening"), F.col("transfer_id")).select("debit_account_id", "left")


def _submitted(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("transfer_id")
    return X.transfers(spark, d).select(F.floor(key / 256).alias("batch_id"), (key % 256).cast("int").alias("idx"), key, "debit_account_id", "credit_account_id", "amount", "ledger", F.lit(0).cast("long").alias("flags"), F.lit(0).cast("long").alias("timeout_ns"), (F.lit(X.EPOCH_NS) + F.floor(key / 256)).alias("now_ns"))


@query(
    ", a AS (SELECT account_id, posted_credits FROM f_accounts WHERE flags = 0), fold AS (SELECT debit_account_id, any_value(posted_credits) AS opening, list(amount ORDER BY transfer_id) AS amounts FROM f_transfers JOIN a ON account_id = debit_account_id GROUP BY 1) "
    "SELECT debit_account_id, CAST(opening - list_reduce(amounts, lambda a, x: CASE WHEN a >= x THEN a - x ELSE a END, opening) AS BIGINT) AS spent FROM fold"
)
def st09_admission_fold(spark: SparkSession, d: str) -> DataFrame:
    """ADM-03..18, ST-06..15: the ordered fold per ledger; what it accepted, by account, over accounts that are neither frozen nor closed."""
    t = _submitted(spark, d)
    out = admission.admit_batches(t, X.accounts(spark, d)).where("ok").select("transfer_id", F.lit(True).alias("accepted"))
    usable = X.accounts(spark, d).where("flags = 0").select(F.col("account_id").alias("debit_account_id"))
    spent = F.sum(F.when(F.col("accepted"), F.col("amount")).otherwise(0))
    return t.join(usable, "debit_account_id").join(out, "transfer_id", "left").groupBy("debit_account_id").agg(spent.alias("spent"))


@query()
def st12_fold_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """ST-09..13 with chains and holds: outcomes of the fold; every seventh item is linked to the next, every third opens a hold."""
    key = F.col("transfer_id")
    t = _submitted(spark, d).withColumns({"flags": (F.when(key % 7 == 0, S.LINKED).otherwise(0) + F.when(key % 3 == 0, S.PENDING).otherwise(0)).cast("long"), "timeout_ns": (key % 4).cast("long")})
    return admission.admit_batches(t, X.accounts(spark, d))


#: Accounts (id, credits, ledger, flags, currency), submitted rows (batch, place, id, debit, credit, amount, ledger, flags, timeout, now) and their outcomes.
GOLDEN_ACCOUNTS = [
    (1, 100, 0, 0, "USD"), (2, 0, 0, 0, "USD"), (3, 0, 0, 0, "USD"), (11, 1000, 0, 0, "USD"), (12, 0, 0, 0, "USD"), (13, 0, 0, 0, "EUR"), (21, 1000, 0, 0, "USD"), (22, 0, 0, 0, "USD"), (31, 1000, 0, 0, "USD"), (32, 0, 0, 0, "USD"),
    (41, 1000, 0, 0, "USD"), (42, 0, 0, 0, "USD"), (43, 0, 0, 1, "USD"), (51, 1000, 0, 0, "USD"), (52, 1000, 0, 0, "USD"), (53, 1000, 0, 0, "USD"), (61, 5000, 100, 0, "USD"), (62, 0, 100, 0, "USD"), (63, 8000, 200, 0, "USD"), (64, 0, 200, 0, "USD"),
]
GOLDEN = [
    ((1, 0, 101, 1, 2, 80, 0, 0, 0, 1), None), ((1, 1, 102, 1, 1, 1, 0, 0, 0, 1), "SelfTransfer"), ((1, 2, 103, 1, 3, 30, 0, 0, 0, 1), "InsufficientFunds"),
    ((2, 0, 111, 11, 12, 100, 0, 0, 0, 2), None), ((2, 1, 112, 11, 12, 0, 0, 0, 0, 2), "ZeroAmount"), ((2, 2, 113, 11, 12, 10000, 0, 0, 0, 2), "InsufficientFunds"), ((2, 3, 114, 11, 12, 50, 0, 0, 0, 2), None), ((2, 4, 115, 11, 999, 10, 0, 0, 0, 2), "AccountNotFound"), ((2, 5, 116, 11, 13, 10, 0, 0, 0, 2), "CurrencyMismatch"),
    ((3, 0, 121, 21, 22, 400, 0, 1, 0, 3), None), ((4, 0, 122, 21, 22, 700, 0, 1, 0, 4), "InsufficientFunds"), ((5, 0, 121, 0, 0, 250, 0, 2, 0, 5), None), ((6, 0, 121, 0, 0, 200, 0, 2, 0, 6), "OverTransfer"), ((7, 0, 121, 0, 0, 0, 0, 2, 0, 7), None),
    ((8, 0, 131, 31, 32, 500, 0, 1, 0, 8), None), ((9, 0, 131, 0, 0, 0, 0, 4, 0, 9), None), ((10, 0, 131, 0, 0, 0, 0, 4, 0, 10), "PendingNotFound"), ((11, 0, 132, 31, 32, 350, 0, 1, 1000, 11), None), ((12, 0, 133, 31, 32, 10, 0, 0, 0, 1011), None), ((13, 0, 132, 0, 0, 0, 0, 2, 0, 1012), "PendingNotFound"),
    ((14, 0, 141, 41, 42, 300, 0, 8, 0, 1013), None), ((14, 1, 142, 42, 41, 300, 0, 0, 0, 1013), None), ((15, 0, 143, 41, 42, 500, 0, 8, 0, 1014), "LinkedChainFailed"), ((15, 1, 144, 42, 43, 500, 0, 0, 0, 1014), "AccountFrozen"), ((16, 0, 145, 41, 42, 100, 0, 8, 0, 1015), "LinkedChainOpen"),
    ((17, 0, 151, 51, 52, 50, 0, 0, 0, 1016), None), ((17, 1, 152, 52, 53, 100, 0, 8, 0, 1016), "LinkedChainFailed"), ((17, 2, 153, 53, 51, 5000, 0, 0, 0, 1016), "InsufficientFunds"), ((17, 3, 154, 53, 52, 30, 0, 0, 0, 1016), None),
    ((18, 0, 161, 61, 63, 100, 100, 0, 0, 1017), "LedgerMismatch"), ((18, 1, 162, 61, 62, 100, 200, 0, 0, 1017), "LedgerMismatch"), ((18, 2, 163, 61, 62, 1500, 100, 0, 0, 1017), None), ((18, 3, 164, 63, 64, 3200, 200, 0, 0, 1017), None),
    ((19, 0, 163, 63, 64, 1, 200, 0, 0, 1018), "DuplicateTransferID"), ((19, 1, 165, 61, 62, 100, 100, 8, 0, 1018), "LinkedChainFailed"), ((19, 2, 166, 63, 64, 99999, 200, 0, 0, 1018), "InsufficientFunds"), ((20, 0, 167, 61, 62, 5, 100, 1, 0, 1019), None), ((21, 0, 167, 0, 0, 0, 200, 2, 0, 1020), "LedgerMismatch"), ((22, 0, 167, 0, 0, 0, 0, 2, 0, 1021), None),
]
_GOLDEN_SQL = ", ".join(f"({r[0]}, {r[1]}, {r[2]}, {'NULL' if e is None else repr(e)})" for r, e in GOLDEN)


@query(f" SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(idx AS INTEGER) AS idx, CAST(transfer_id AS BIGINT) AS transfer_id, error_code FROM (VALUES {_GOLDEN_SQL}) v(batch_id, idx, transfer_id, error_code)")
def st12_golden_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """ADM-03..18, ST-09..13: outcomes that are known by heart, of funds, holds, expiry, chains, tenants, repeated ids and posts that inherit their ledger."""
    names = "batch_id long, idx int, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, timeout_ns long, now_ns long"
    zero = F.lit(0).cast("long")
    accounts = spark.createDataFrame(GOLDEN_ACCOUNTS, "account_id long, posted_credits long, ledger long, flags long, currency string").withColumns({"posted_debits": zero, "pending_debits": zero, "pending_credits": zero})
    return admission.admit_batches(spark.createDataFrame([r for r, _ in GOLDEN], names), accounts).select("batch_id", "idx", "transfer_id", "error_code")


_CHAINS = """, c1 AS (SELECT *, CASE WHEN coalesce(lag(linked) OVER (PARTITION BY batch_id ORDER BY idx), false) THEN 0 ELSE 1 END AS s FROM f_commands),
c2 AS (SELECT *, sum(s) OVER (PARTITION BY batch_id ORDER BY idx) AS chain_no FROM c1),
c3 AS (SELECT *, count(*) OVER c AS chain_size, arg_max(linked, idx) OVER c AS chain_open, CASE WHEN amount % 10 = 0 THEN 'ZeroAmount' END AS error_code, max(idx) OVER c AS last FROM c2 WINDOW c AS (PARTITION BY batch_id, chain_no)),
c4 AS (SELECT *, min(CASE WHEN error_code IS NOT NULL THEN idx END) OVER (PARTITION BY batch_id, chain_no) AS first_bad FROM c3)
"""


@query(
    f"{_CHAINS} SELECT event_id, CAST(chain_no AS BIGINT) AS chain_no, chain_size, chain_open, CASE WHEN first_bad IS NOT NULL AND idx = first_bad THEN error_code WHEN first_bad IS NOT NULL THEN 'LinkedChainFailed' "
    "WHEN chain_open AND idx = last THEN 'LinkedChainOpen' WHEN chain_open THEN 'LinkedChainFailed' END AS outcome FROM c4"
)
def st14_chains(spark: SparkSession, d: str) -> DataFrame:
    """ST-12..14, WN-07: chains of client batches and what the errors of single legs do to them."""
    c = X.commands(spark, d).withColumn("error_code", F.when(F.col("amount") % 10 == 0, "ZeroAmount"))
    return admission.chain_outcomes(c).select("event_id", "chain_no", "chain_size", "chain_open", "outcome")


@query("SELECT event_id, row_number() OVER (PARTITION BY batch_id, idempotency_key ORDER BY idx) > 1 AS conflict, min(event_id) OVER (PARTITION BY idempotency_key) AS original_id FROM f_commands")
def st16_idempotency(spark: SparkSession, d: str) -> DataFrame:
    """ST-16, ST-19: conflicts within a client batch, and the original of every key."""
    c = idempotency.first_use(X.commands(spark, d))
    return idempotency.in_batch_conflicts(c).select("event_id", "conflict", "original_id")


@query(
    ", o AS (SELECT *, amount % 10 <> 0 AS ok FROM f_commands), f AS (SELECT idempotency_key, min(event_id) AS original_id FROM o WHERE ok GROUP BY 1) "
    "SELECT event_id, ok, original_id, coalesce(event_id > original_id, false) AS replayed FROM o LEFT JOIN f USING (idempotency_key)"
)
def st17_first_success(spark: SparkSession, d: str) -> DataFrame:
    """ST-17: a failure frees its key for a later row."""
    return idempotency.first_success(X.commands(spark, d).withColumn("ok", F.col("amount") % 10 != 0)).select("event_id", "ok", "original_id", "replayed")


@query(", t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 40 END AS k, event_id * 1000000 AS ts_us FROM f_commands), l AS (SELECT k, list({'e': event_id, 't': ts_us} ORDER BY ts_us) AS us FROM t WHERE k IS NOT NULL GROUP BY 1), "
    "r AS (SELECT list_reduce(us, lambda a, x: {'since': CASE WHEN x.t - a.since <= 900000000 THEN a.since ELSE x.t END, 'seen': CASE WHEN x.t - a.since <= 900000000 THEN list_append(a.seen, x.e) ELSE a.seen END, 'e': x.e, 't': x.t}, {'since': CAST(-1000000000 AS BIGINT), 'seen': CAST([] AS BIGINT[]), 'e': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT)}) AS o FROM (SELECT list_transform(us, lambda x: {'since': CAST(0 AS BIGINT), 'seen': CAST([] AS BIGINT[]), 'e': x.e, 't': x.t}) AS us FROM l)), s AS (SELECT unnest(o.seen) AS event_id FROM r) "
    "SELECT event_id, event_id NOT IN (SELECT event_id FROM s) AS fresh FROM t")
def st18_key_ttl(spark: SparkSession, d: str) -> DataFrame:
    """ST-18: keys within their time to live from the use that committed them; rows without a key are always fresh."""
    key = F.when(F.col("event_id") % 11 != 0, F.col("user_id") % 40)
    return idempotency.within_ttl(X.commands(spark, d).withColumns({"ts_us": F.col("event_id") * 1_000_000, "idempotency_key": key}), S.KEY_TTL_S * 1_000_000).select("event_id", "fresh")


@query(f"{HOLDS} SELECT * FROM holds")
def st04_holds(spark: SparkSession, d: str) -> DataFrame:
    """ST-03..06: every hold's remainder and status as of the last record's clock."""
    return journal.holds(X.journal(spark, d))


@query(f"{HOLDS} SELECT transfer_id, \"left\", deadline_ns FROM holds WHERE status = 'open'")
def q07_open_holds(spark: SparkSession, d: str) -> DataFrame:
    """Q-07."""
    return journal.holds(X.journal(spark, d)).where("status = 'open'").select("transfer_id", "left", "deadline_ns")


@query(f"{HOLDS}, x AS (SELECT debit_account_id AS account_id, \"left\" AS d, 0 AS c FROM holds WHERE status = 'expired' UNION ALL SELECT credit_account_id, 0, \"left\" FROM holds WHERE status = 'expired') SELECT account_id, CAST(sum(d) AS BIGINT) AS released_debits, CAST(sum(c) AS BIGINT) AS released_credits FROM x GROUP BY 1")
def st06_expiry(spark: SparkSession, d: str) -> DataFrame:
    """ST-06, SM-05, SM-06: pending amounts that expiry gives back, by account."""
    h = journal.holds(X.journal(spark, d)).where("status = 'expired'")
    zero = F.lit(0).cast("long")
    both = F.array(F.struct(F.col("debit_account_id").alias("account_id"), F.col("left").alias("d"), zero.alias("c")), F.struct(F.col("credit_account_id").alias("account_id"), zero.alias("d"), F.col("left").alias("c")))
    return h.select(F.explode(both).alias("x")).groupBy("x.account_id").agg(F.sum("x.d").alias("released_debits"), F.sum("x.c").alias("released_credits"))


@query(f"{LEGS} SELECT account_id, balance FROM full_state WHERE account_id = 7")
def q01_account(spark: SparkSession, d: str) -> DataFrame:
    """Q-01, Q-02: one account's balance; the filter reaches both sides before any sum."""
    return _state(spark, d).where("account_id = 7").select("account_id", "balance")


@query(", m AS (SELECT transfer_id, max(lsn) AS lsn FROM f_journal GROUP BY 1), p AS (SELECT transfer_id, max(debit_account_id) AS d, max(credit_account_id) AS c FROM f_journal GROUP BY 1) SELECT transfer_id, lsn, d AS debit_account_id, c AS credit_account_id, amount, ledger, flags, ts_ns FROM f_journal JOIN m USING (transfer_id, lsn) JOIN p USING (transfer_id)")
def q03_latest(spark: SparkSession, d: str) -> DataFrame:
    """Q-03, ST-26, ST-27: the latest version of every transfer."""
    return journal.latest(X.journal(spark, d))


@query(f"{LEGS} SELECT account_id, lsn, transfer_id, row_number() OVER (PARTITION BY account_id ORDER BY lsn) AS \"position\" FROM (SELECT DISTINCT account_id, lsn, transfer_id FROM legs) x")
def q04_history(spark: SparkSession, d: str) -> DataFrame:
    """Q-04, WN-06: every account's history with positions."""
    return journal.history(X.journal(spark, d))


@query(f"{LEGS}, own AS (SELECT lsn, transfer_id, row_number() OVER (ORDER BY lsn) AS \"position\" FROM legs WHERE account_id = {X.SINK}) SELECT transfer_id, \"position\" FROM own WHERE \"position\" > 5 AND \"position\" <= 55")
def q04_page(spark: SparkSession, d: str) -> DataFrame:
    """Q-04: a page of 50 of one sink's history after the transfer at position 5's place (keyset)."""
    own = journal.history(X.journal(spark, d).where(F.col("ledger") == 0)).where(F.col("account_id") == X.SINK)
    return own.where(F.col("position") > 5).orderBy("position").limit(S.PAGE).select("transfer_id", "position")


@query("SELECT count(*) AS accounts, count(DISTINCT ledger) AS ledgers FROM f_accounts")
def q08_account_count(spark: SparkSession, d: str) -> DataFrame:
    """Q-08."""
    return X.accounts(spark, d).agg(F.count("*").alias("accounts"), F.count_distinct("ledger").alias("ledgers"))


@query(f"{LEGS.replace('FROM f_journal WINDOW', 'FROM f_journal WHERE lsn <= 5000 WINDOW')} SELECT account_id, balance, available FROM full_state")
def q09_view_at(spark: SparkSession, d: str) -> DataFrame:
    """Q-09: the state as of one LSN."""
    return journal.balances(X.accounts(spark, d), X.journal(spark, d).where("lsn <= 5000")).select("account_id", "balance", "available")


@query("SELECT max(lsn) AS head_lsn, min(lsn) AS first_lsn, max(ts_ns) AS clock_ns, max(lsn) - 5000 AS lag FROM f_journal")
def q10_head(spark: SparkSession, d: str) -> DataFrame:
    """Q-10, Q-12, AG-14, SM-07: head LSN, clock, lag behind a follower."""
    return X.journal(spark, d).agg(F.max("lsn").alias("head_lsn"), F.min("lsn").alias("first_lsn"), F.max("ts_ns").alias("clock_ns"), (F.max("lsn") - 5000).alias("lag"))


@query("SELECT lsn, transfer_id, flags FROM f_journal WHERE lsn > 20000")
def src05_delta(spark: SparkSession, d: str) -> DataFrame:
    """SRC-05: records above an LSN."""
    return X.journal(spark, d).where("lsn > 20000").select("lsn", "transfer_id", "flags")


@query("SELECT range AS transfer_id, sha256(CAST(range AS VARCHAR)) AS idempotency_key, 100 AS amount, range % 10 AS debit_account_id, (range + 1) % 10 AS credit_account_id FROM range(10000)")
def src21_generator(spark: SparkSession, d: str) -> DataFrame:
    """SRC-20, SRC-21: synthetic transfers, deterministic."""
    i = F.col("id")
    return spark.range(10_000).select(i.alias("transfer_id"), F.sha2(i.cast("string"), 256).alias("idempotency_key"), F.lit(100).alias("amount"), (i % 10).alias("debit_account_id"), ((i + 1) % 10).alias("credit_account_id"))


@query(f"{LEGS} SELECT ledger, CAST(sum(opening) AS BIGINT) AS injected, CAST(sum(CASE WHEN posted_debits <= posted_credits THEN posted_credits - posted_debits ELSE 0 END) AS BIGINT) AS final, sum(opening) = sum(CASE WHEN posted_debits <= posted_credits THEN posted_credits - posted_debits ELSE 0 END) AS conserved FROM full_state GROUP BY 1")
def ag04_conservation(spark: SparkSession, d: str) -> DataFrame:
    """AG-02..04: injected credits against final balances of every ledger."""
    accounts = X.accounts(spark, d)
    return journal.conservation(accounts, journal.balances(accounts, X.journal(spark, d)))


@query(f"{LEGS} SELECT CAST(sum(posted_debits) AS BIGINT) AS debits, CAST(sum(posted_credits) AS BIGINT) AS credits, sum(posted_debits) = sum(posted_credits) AS equal FROM legs")
def ag06_mirror_check(spark: SparkSession, d: str) -> DataFrame:
    """AG-06, SRC-15: debits equal credits over all records."""
    return journal.legs(X.journal(spark, d)).agg(F.sum("posted_debits").alias("debits"), F.sum("posted_credits").alias("credits"), (F.sum("posted_debits") == F.sum("posted_credits")).alias("equal"))


@query(
    ", r AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), l AS (SELECT event_type, list(v ORDER BY v) AS vs, count(*) AS n FROM r GROUP BY 1) "
    "SELECT event_type, vs[n * 50 // 100 + 1] AS p50, vs[n * 95 // 100 + 1] AS p95, vs[n * 99 // 100 + 1] AS p99, n FROM l"
)
def ag07_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """AG-07: exact nearest-rank percentiles by event type."""
    v = X.table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return metrics.nearest_rank(v, "v", (50, 95, 99), ["event_type"])


@query("SELECT event_type, count(*) AS ops, count(*) * 1000000000 / 250000000 AS per_second FROM events GROUP BY 1")
def ag08_throughput(spark: SparkSession, d: str) -> DataFrame:
    """AG-08: operations over an elapsed time of a quarter of a second."""
    rows = X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("ops"))
    return rows.withColumn("per_second", metrics.throughput(F.col("ops"), F.lit(250_000_000)))


@query(
    ", b AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CAST(least(greatest(ceil((n - 1) / 500.0), 0), 20) AS INTEGER) AS bucket, "
    "CAST(len(list_filter(list_transform(range(16), lambda k: power(2, k)), lambda e: e < n)) AS INTEGER) AS latency_bucket, count(*) AS n FROM b GROUP BY 1, 2"
)
def ag10_histograms(spark: SparkSession, d: str) -> DataFrame:
    """AG-10, AG-11: linear and exponential histograms of batch sizes."""
    b = X.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("size"))
    return b.groupBy(metrics.linear_bucket(F.col("size"), 1, 500, 20).alias("bucket"), metrics.exponential_bucket(F.col("size"), 1.0, 16).alias("latency_bucket")).agg(F.count("*").alias("n"))


@query(f"{LEGS} SELECT ledger, count(*) FILTER (WHERE balance IS NULL OR available IS NULL) AS violations, count(*) AS accounts FROM full_state GROUP BY 1")
def ag12_invariants(spark: SparkSession, d: str) -> DataFrame:
    """AG-12: accounts that break an invariant, by ledger."""
    return _state(spark, d).groupBy("ledger").agg(F.count_if(F.col("error_code").isNotNull()).alias("violations"), F.count("*").alias("accounts"))


@query(f"{LEGS} SELECT l.account_id, lsn, CAST(l.posted_credits - l.posted_debits AS BIGINT) AS delta, CAST(a.posted_credits + sum(l.posted_credits - l.posted_debits) OVER (PARTITION BY l.account_id ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_balance FROM legs l JOIN f_accounts a ON a.account_id = l.account_id")
def wn08_running_balance(spark: SparkSession, d: str) -> DataFrame:
    """WN-08."""
    return journal.running_balances(X.accounts(spark, d), X.journal(spark, d))


@query("SELECT batch_id, count(DISTINCT ts_ns) AS clocks, min(ts_ns) > coalesce(max(max(ts_ns)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rises FROM f_journal GROUP BY batch_id")
def wn09_batch_clock(spark: SparkSession, d: str) -> DataFrame:
    """WN-09: clocks of each batch, and whether they rise from batch to batch (one row for each batch is ordered)."""
    b = X.journal(spark, d).groupBy("batch_id").agg(F.count_distinct("ts_ns").alias("clocks"), F.min("ts_ns").alias("low"), F.max("ts_ns").alias("high"))
    before = F.max("high").over(W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1))
    return b.select("batch_id", "clocks", (F.col("low") > F.coalesce(before, F.lit(0))).alias("rises"))


@query("SELECT batch_id AS segment, max(lsn) AS max_lsn, row_number() OVER (ORDER BY batch_id DESC) <= 3 AS keeps, max(lsn) < 10000 AND batch_id < (SELECT max(batch_id) FROM f_journal) AS droppable FROM f_journal GROUP BY batch_id")
def snk12_retention(spark: SparkSession, d: str) -> DataFrame:
    """SNK-07, SNK-12, WN-10: segments that retention keeps, and those below an LSN that it may drop."""
    from abacorn.sources import snapshot

    s = X.journal(spark, d).groupBy(F.col("batch_id").alias("segment")).agg(F.max("lsn").alias("max_lsn"))
    gone = snapshot.truncatable(s, 10_000).select("segment", F.lit(True).alias("droppable"))
    kept = snapshot.retained(s.withColumnRenamed("segment", "lsn").withColumnRenamed("max_lsn", "top"))
    return kept.select(F.col("lsn").alias("segment"), F.col("top").alias("max_lsn"), "keeps").join(gone, "segment", "left").withColumn("droppable", F.coalesce("droppable", F.lit(False)))


_FRAMES_SQL = """, fr AS (SELECT event_id, event_id // 500 AS segment, event_id % 500 AS "offset", CASE WHEN event_id % 997 = 5 THEN event_id - 3 ELSE event_id END AS lsn,
  CASE WHEN event_id % 50 = 49 THEN 4 WHEN event_id % 613 = 7 THEN 9 ELSE 3 END AS type, event_id % 401 <> 11 AS crc_ok, event_id % 500 = 499 AND event_id % 1000 < 500 AS torn,
  CASE WHEN event_id % 350 = 349 THEN 7 ELSE 49 END AS expected FROM events)
"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of checkpoints and commits with planted faults."""
    i = F.col("event_id")
    none = lambda t: F.lit(None).cast(t)
    return X.table(spark, d, "events").select(
        F.floor(i / 500).alias("segment"), (i % 500).alias("offset"), F.when(i % 997 == 5, i - 3).otherwise(i).alias("lsn"),
        F.when(i % 50 == 49, S.COMMIT).when(i % 613 == 7, 9).otherwise(S.CHECKPOINT).alias("type"), (i % 401 != 11).alias("crc_ok"), ((i % 500 == 499) & (i % 1000 < 500)).alias("torn"),
        F.lit(True).alias("decodes"), F.when(i % 350 == 349, 7).otherwise(49).alias("expected"), *(none("long").alias(c) for c in ("transfer_id", "debit_account_id", "credit_account_id", "amount", "ledger", "flags", "idempotency_key", "account_id", "posted_debits", "posted_credits")),
    )


@query(
    f"""{_FRAMES_SQL}, w AS (SELECT * FROM fr WHERE crc_ok AND NOT torn), o AS (SELECT *, lag(lsn) OVER (ORDER BY segment, "offset") AS before FROM w),
u AS (SELECT *, CASE WHEN crc_ok AND NOT torn AND type = 3 THEN 1 ELSE 0 END AS counted FROM fr), v AS (SELECT *, sum(counted) OVER (ORDER BY segment, "offset" ROWS UNBOUNDED PRECEDING) AS upto FROM u),
c AS (SELECT *, upto - coalesce(lag(upto) OVER (ORDER BY segment, "offset"), 0) AS n FROM v WHERE type = 4 AND crc_ok AND NOT torn)
SELECT 'corrupt_frame' AS kind, segment, lsn FROM fr WHERE NOT torn AND NOT crc_ok UNION ALL SELECT 'torn_tail', segment, lsn FROM fr WHERE torn
UNION ALL SELECT 'lsn_order', segment, lsn FROM o WHERE lsn <= before UNION ALL SELECT 'unknown_record_type', segment, lsn FROM w WHERE type = 9 UNION ALL SELECT 'batch_count_mismatch', segment, lsn FROM c WHERE n <> expected"""
)
def au01_frame_faults(spark: SparkSession, d: str) -> DataFrame:
    """AU-01..04, AU-07, WN-01, WN-02: planted faults of frames, order and batch counts."""
    return audit.violations(_frames(spark, d)).select("kind", "segment", "lsn")


@query()
def au08_report(spark: SparkSession, d: str) -> DataFrame:
    """AU-08, AG-05: the audit's summary row."""
    return audit.report(_frames(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The accounts and the journal as sound frames, with planted repeats of ids and keys."""
    none = lambda t: F.lit(None).cast(t)
    flat = {"segment": F.lit(1).cast("long"), "crc_ok": F.lit(True), "torn": F.lit(False), "decodes": F.lit(True), "expected": none("int")}
    a = X.accounts(spark, d).withColumns(flat | {"lsn": F.col("account_id") - 2 * X.SINK, "type": F.lit(S.ACCOUNT), **{c: none("long") for c in ("transfer_id", "debit_account_id", "credit_account_id", "amount", "idempotency_key")}, "flags": none("long")})
    key = F.col("transfer_id")
    renamed = F.when((key % 200 == 9) & (F.col("flags") == 0), key - 4).otherwise(key)
    t = X.journal(spark, d).withColumns(flat | {"type": F.lit(S.TRANSFER), "idempotency_key": F.when(F.col("flags") < 2, key % 5000), **{c: none("long") for c in ("account_id", "posted_debits", "posted_credits")}, "transfer_id": renamed})
    columns = ["segment", "lsn", "type", "crc_ok", "torn", "decodes", "expected", "transfer_id", "debit_account_id", "credit_account_id", "amount", "ledger", "flags", "idempotency_key", "account_id", "posted_debits", "posted_credits"]
    return a.select(columns).union(t.select(columns)).withColumn("offset", F.col("lsn"))


_ENTRIES = """, e AS (SELECT lsn, CASE WHEN transfer_id % 200 = 9 AND flags = 0 THEN transfer_id - 4 ELSE transfer_id END AS transfer_id, flags, CASE WHEN flags < 2 THEN transfer_id % 5000 END AS k, ledger, debit_account_id, amount FROM f_journal),
again AS (SELECT lsn, row_number() OVER (PARTITION BY transfer_id ORDER BY lsn) AS nth FROM e WHERE flags < 2), shared AS (SELECT lsn, transfer_id, first_value(transfer_id) OVER (PARTITION BY k ORDER BY lsn) AS f FROM e WHERE k IS NOT NULL)
"""


@query(f"{_ENTRIES} SELECT lsn FROM again WHERE nth > 1 UNION ALL SELECT lsn FROM shared WHERE f <> transfer_id")
def au06_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """AU-06, WN-03, WN-04: repeated transfer ids and shared keys."""
    return audit.duplicates(_entries(spark, d)).select("lsn")


@query(f"{LEGS} SELECT 'account' AS what, count(*) AS n FROM full_state WHERE posted_debits > posted_credits UNION ALL SELECT 'ledger', count(*) FROM (SELECT ledger FROM full_state GROUP BY 1 HAVING sum(opening) <> sum(CASE WHEN posted_debits <= posted_credits THEN posted_credits - posted_debits ELSE 0 END)) x")
def au05_conservation(spark: SparkSession, d: str) -> DataFrame:
    """AU-05, WN-05: accounts and ledgers that don't add up, from the records alone."""
    clean = _entries(spark, d).withColumn("transfer_id", F.when((F.col("type") == S.TRANSFER), F.floor((F.col("lsn") - 1) / 2)))
    v = audit.conservation(clean)
    n = lambda text: F.count_if(F.col("detail").startswith(text))
    both = v.agg(n("account ends").alias("account"), n("ledger ").alias("ledger"))
    return both.select(F.explode(F.array(F.struct(F.lit("account").alias("what"), F.col("account").alias("n")), F.struct(F.lit("ledger").alias("what"), F.col("ledger").alias("n")))).alias("x")).select("x.*")


@query("SELECT event_id, user_id % 7 AS term FROM (SELECT *, max(user_id % 7) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS top FROM events) x WHERE user_id % 7 >= top")
def sm08_term_fence(spark: SparkSession, d: str) -> DataFrame:
    """SM-08: frames of superseded terms are refused."""
    from abacorn.streaming.admission import fence

    e = X.table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("term"), F.col("event_type").alias("stream"), F.col("event_id").alias("arrival"))
    return fence(e).select("event_id", "term")


@query(
    f"""{LEGS}, sub AS (SELECT transfer_id, debit_account_id, amount, CAST(transfer_id % 2 AS BIGINT) AS flags FROM f_transfers)
SELECT transfer_id, CASE WHEN amount = 0 THEN 'ZeroAmount' WHEN a.flags & 1 <> 0 THEN 'AccountFrozen' WHEN a.flags & 2 <> 0 THEN 'AccountClosed'
  WHEN sub.flags = 1 AND available IS NULL OR sub.flags = 0 AND balance IS NULL THEN 'InvariantViolation' WHEN CASE WHEN sub.flags = 1 THEN available ELSE balance END < amount THEN 'InsufficientFunds' END AS error_code
FROM sub JOIN full_state a ON a.account_id = debit_account_id"""
)
def q11_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Q-11: what every submitted transfer would get alone against the current state."""
    t = X.transfers(spark, d).select("transfer_id", "debit_account_id", "credit_account_id", "amount", "ledger", (F.col("transfer_id") % 2).alias("flags"))
    return admission.dry_run(t, _state(spark, d)).select("transfer_id", "error_code")


@query(
    ", b AS (SELECT event_id // 100 AS batch_id, max(value) AS v FROM events GROUP BY 1), n AS (SELECT batch_id, CAST(floor(v) AS BIGINT) AS now_ns, row_number() OVER (ORDER BY batch_id) AS r FROM b) "
    "SELECT batch_id, max(now_ns - r) OVER (ORDER BY batch_id) + r AS clock_ns FROM n"
)
def fn27_batch_clock(spark: SparkSession, d: str) -> DataFrame:
    """FN-27, ST-24: the clock of each batch never stands still."""
    e = X.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("batch_id")).agg(F.floor(F.max("value")).alias("now_ns"))
    return admission.batch_clock(e).select("batch_id", "clock_ns")


@query(
    ", t AS (SELECT transfer_id // 20 AS batch_id, CAST(transfer_id % 20 AS INTEGER) AS idx, transfer_id, amount FROM f_transfers), bad AS (SELECT batch_id, bool_and(transfer_id % 97 <> 0) AS ok FROM t GROUP BY 1) "
    "SELECT batch_id, ok, lpad(to_hex(transfer_id), 32, '0') AS id_hex, CASE WHEN transfer_id % 97 <> 0 THEN amount END AS amount, upper(sha256('k' || CAST(transfer_id AS VARCHAR))) AS key_hex FROM t JOIN bad USING (batch_id)"
)
def src16_json_requests(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16: batches of JSON items decoded by schema; an item without a valid amount rejects its batch."""
    from abacorn.sources import requests

    key, digits = F.col("transfer_id"), lambda c: F.lpad(F.hex(F.col(c)), 32, "0")
    item = F.struct(digits("transfer_id").alias("id"), digits("debit_account_id").alias("debit_account_id"), F.concat(F.lit("0x"), digits("credit_account_id")).alias("credit_account_id"), F.when(key % 97 == 0, "-5").otherwise(F.col("amount").cast("string")).alias("amount"), F.concat(F.lit("k"), key.cast("string")).alias("idempotency_key"))
    sent = X.transfers(spark, d).groupBy(F.floor(key / 20).alias("batch_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))
    out = requests.batches(sent)
    return out.select("batch_id", "ok", F.hex("item.transfer_id").alias("id_hex"), F.col("item.amount").cast("long").alias("amount"), F.hex("item.idempotency_key").alias("key_hex"))


@query("SELECT account_id, ledger FROM f_accounts WHERE ledger = 1")
def src14_mirror(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14, SRC-18, Q-05: accounts of one tenant from the relational mirror's schema; the filter is pushed to the scan."""
    return X.accounts(spark, d).where("ledger = 1").select("account_id", "ledger")
