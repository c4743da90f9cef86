"""Scalar functions over accounts, transfers and what arrives at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions.money import add, subtract

ZERO_16 = "0" * 32


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def balance(debits: Column, credits: Column) -> Column:
    """posted credits - posted debits; null breaks the invariant."""
    return subtract(credits, debits)


def available(posted_debits: Column, posted_credits: Column, pending_debits: Column, pending_credits: Column) -> Column:
    """((posted credits - posted debits) - pending debits) + pending credits; null as soon as a step fails."""
    return add(subtract(balance(posted_debits, posted_credits), pending_debits), pending_credits)


def is_frozen(flags: Column) -> Column:
    return has(flags, S.FROZEN)


def is_closed(flags: Column) -> Column:
    return has(flags, S.CLOSED)


def unknown_flags(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(~S.KNOWN_FLAGS)) != 0


def kinds(flags: Column) -> Column:
    """How many of pending, post and void are set."""
    return sum((F.when(has(flags, b), 1).otherwise(0) for b in (S.PENDING, S.POST, S.VOID)), F.lit(0))


def deadline(ts_ns: Column, timeout_ns: Column) -> Column:
    """Clock at which a hold expires, null for never."""
    return F.when(timeout_ns > 0, ts_ns.cast("decimal(21,0)") + timeout_ns.cast("decimal(20,0)")).cast("decimal(21,0)")


def parse_id(s: Column) -> Column:
    """16 bytes from 32 hex digits, with or without 0x; null otherwise."""
    digits = F.regexp_replace(s, "^0x", "")
    return F.when(digits.rlike("^[0-9a-fA-F]{32}$"), F.unhex(digits))


def check_id(b: Column) -> Column:
    return F.when(F.octet_length(b) == 16, b)


def parse_user_data(s: Column) -> Column:
    """32 hex digits as bytes, or the first 16 bytes of the text, padded with zero bytes."""
    raw = F.substring(s.cast("binary"), 1, 16)
    return F.coalesce(parse_id(s), F.unhex(F.rpad(F.hex(raw), 32, "0")))


def show_user_data(b: Column) -> Column:
    return F.when(F.hex(b) == ZERO_16, "").otherwise(F.lower(F.hex(b)))


def idempotency_key(s: Column, raw_32: bool = False) -> Column:
    """32 bytes of key: SHA-256 of the text, the text itself if raw_32 and it has 32 bytes, null for none."""
    key = F.unhex(F.sha2(s, 256))
    key = F.when(F.octet_length(s) == 32, s.cast("binary")).otherwise(key) if raw_32 else key
    return F.when(F.length(s) > 0, key)


def currency(s: Column) -> Column:
    """At most four bytes, without NUL bytes at the end."""
    return F.regexp_replace(F.substring(s.cast("binary"), 1, 4).cast("string"), "\\x00+$", "")


def account_error(flags: Column, account_id: Column, side_frozen: str = "AccountFrozen", side_closed: str = "AccountClosed") -> Column:
    return F.when(is_frozen(flags), side_frozen).when(is_closed(flags), side_closed)


def detail(code: Column, subject: Column) -> Column:
    """The detail text of an error about subject."""
    return F.replace(S.lookup(code, 3), F.lit("%s"), F.coalesce(subject.cast("string"), F.lit("")))


def transfer_view(t: DataFrame) -> DataFrame:
    """What a client sees of decoded transfers: lowercase hex of ids and key (zeros for none), the amount as text, user data as hex or empty."""
    shown = lambda c: F.lower(F.hex(c)).alias(c)
    key = F.coalesce(F.lower(F.hex("idempotency_key")), F.lit("0" * 64)).alias("idempotency_key")
    return t.select(
        shown("transfer_id").alias("id"), shown("debit_account_id"), shown("credit_account_id"), F.col("amount").cast("string").alias("amount"), key,
        "flags", F.col("timeout_ns").alias("timeout"), F.col("ts_ns").alias("created_at"), "ledger", "code", show_user_data(F.col("user_data")).alias("user_data"),
    )
