"""Types, flags and error codes of the ledger's data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(38, 0)
U64 = T.DecimalType(20, 0)

#: Account and transfer flags.
FROZEN, CLOSED = 1, 2
PENDING, POST, VOID, LINKED = 1, 2, 4, 8
KNOWN_FLAGS = PENDING | POST | VOID | LINKED

#: Record types of the journal.
TRANSFER, ACCOUNT, CHECKPOINT, COMMIT = 1, 2, 3, 4

#: Items of one client batch, rows of a page at the edge, snapshots kept, seconds and entries of the idempotency store.
BATCH_LIMIT, PAGE, SNAPSHOTS_KEPT, KEY_TTL_S, KEY_LIMIT = 8192, 50, 3, 900, 100_000

#: Error code, HTTP status, gRPC status, detail template.
ERRORS = [
    ("NotLeader", 503, "Unavailable", "this node is a follower"),
    ("ZeroAmount", 400, "InvalidArgument", "amount is zero"),
    ("SelfTransfer", 500, "Internal", "debit and credit account are both %s"),
    ("PendingNotFound", 404, "NotFound", "no open hold %s"),
    ("InvalidTransferFlags", 400, "InvalidArgument", "flags %s are not allowed"),
    ("OverTransfer", 422, "FailedPrecondition", "amount exceeds what hold %s has left"),
    ("AccountNotFound", 404, "NotFound", "no account %s"),
    ("InsufficientFunds", 422, "FailedPrecondition", "account %s has too little"),
    ("LedgerMismatch", 400, "InvalidArgument", "accounts are not of ledger %s"),
    ("LinkedChainFailed", 422, "Aborted", "another leg failed: %s"),
    ("LinkedChainOpen", 400, "InvalidArgument", "the batch ends within a chain at %s"),
    ("DuplicateTransferID", 409, "AlreadyExists", "transfer %s exists"),
    ("DuplicateAccountID", 409, "AlreadyExists", "account %s exists"),
    ("TransferNotFound", 404, "NotFound", "no transfer %s"),
    ("AccountFrozen", 500, "Internal", "account %s is frozen"),
    ("AccountClosed", 500, "Internal", "account %s is closed"),
    ("CurrencyMismatch", 500, "Internal", "currencies differ: %s"),
    ("BalanceOverflow", 500, "Internal", "balance of %s overflows"),
    ("InvariantViolation", 500, "Internal", "account %s breaks an invariant"),
    ("IdempotencyConflict", 500, "Internal", "key of %s is in use"),
    ("BufferFull", 500, "Internal", "the queue is full"),
    ("LedgerClosed", 500, "Internal", "the ledger is closed"),
    ("BatchTooLarge", 500, "Internal", "the batch has %s items"),
    ("OutOfDomain", 400, "InvalidArgument", "%s is beyond 38 digits"),
]

ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.BinaryType()), T.StructField("currency", T.StringType()), T.StructField("ledger", T.LongType()), T.StructField("code", T.IntegerType()),
        T.StructField("flags", T.LongType()), T.StructField("user_data", T.BinaryType()), T.StructField("posted_debits", MONEY), T.StructField("posted_credits", MONEY),
        T.StructField("pending_debits", MONEY), T.StructField("pending_credits", MONEY),
    ]
)

TRANSFERS = T.StructType(
    [
        T.StructField("transfer_id", T.BinaryType()), T.StructField("debit_account_id", T.BinaryType()), T.StructField("credit_account_id", T.BinaryType()), T.StructField("amount", MONEY),
        T.StructField("idempotency_key", T.BinaryType()), T.StructField("user_data", T.BinaryType()), T.StructField("ts_ns", T.LongType()), T.StructField("timeout_ns", U64),
        T.StructField("ledger", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("flags", T.LongType()),
    ]
)


def lookup(code: Column, field: int) -> Column:
    """HTTP status (1), gRPC status (2) or detail template (3) of an error code."""
    return F.element_at(F.create_map(*(F.lit(x) for e in ERRORS for x in (e[0], e[field]))), code)
