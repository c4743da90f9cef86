"""Unsigned money: DECIMAL(38,0) by default, (hi, lo) words for all 128 bits. Functions return null where the checked operation fails."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from abacorn.schema import MONEY, U64

WORD = Decimal(1 << 64)


def money(x: Column) -> Column:
    return x.cast(MONEY)


def add(a: Column, b: Column) -> Column:
    """a + b, null beyond 38 digits."""
    return F.try_add(money(a), money(b)).cast(MONEY)


def subtract(a: Column, b: Column) -> Column:
    """a - b, null if b is greater: money is never negative."""
    return F.when(money(a) >= money(b), F.try_subtract(money(a), money(b)).cast(MONEY))


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(money(a), money(b)).cast(MONEY)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(money(a) < money(b), -1).when(money(a) > money(b), 1).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0))


def parse(s: Column) -> Column:
    """Digits only, leading zeros allowed; null for anything else and beyond 38 digits."""
    return F.when(s.rlike("^[0-9]+$"), s.try_cast(MONEY))


def show(x: Column) -> Column:
    return money(x).cast("string")


def _word(hexes: Column, at: int) -> Column:
    return F.conv(F.substring(hexes, at, 16), 16, 10).cast(U64)


def exact(hi: Column, lo: Column) -> Column:
    """The exact form; hi and lo are DECIMAL(20,0) words below 2^64."""
    return F.struct(hi.cast(U64).alias("hi"), lo.cast(U64).alias("lo"))


def exact_from_binary(b: Column) -> Column:
    """16 bytes, big-endian; null for any other length."""
    return F.when(F.octet_length(b) == 16, exact(_word(F.hex(b), 1), _word(F.hex(b), 17)))


def exact_to_binary(x: Column) -> Column:
    word = lambda w: F.unhex(F.lpad(F.conv(w.cast("string"), 10, 16), 16, "0"))
    return F.concat(word(x["hi"]), word(x["lo"]))


def exact_add(a: Column, b: Column) -> Column:
    """Sum with carry, null from 2^128."""
    low = a["lo"].cast("decimal(22,0)") + b["lo"]
    carry = F.when(low >= F.lit(WORD), 1).otherwise(0)
    high = a["hi"].cast("decimal(22,0)") + b["hi"] + carry
    return F.when(high < F.lit(WORD), exact(high, low - carry * F.lit(WORD)))


def exact_subtract(a: Column, b: Column) -> Column:
    """Difference with borrow, null if b is greater."""
    borrow = F.when(a["lo"] < b["lo"], 1).otherwise(0)
    fits = (a["hi"] > b["hi"]) | ((a["hi"] == b["hi"]) & (a["lo"] >= b["lo"]))
    return F.when(fits, exact(a["hi"] - b["hi"] - borrow, a["lo"].cast("decimal(22,0)") + borrow * F.lit(WORD) - b["lo"]))


def exact_sum(x: Column) -> Column:
    """Aggregate of exact values, carried; null from 2^128."""
    low, high, word = F.sum(x["lo"]), F.sum(x["hi"]), F.lit(WORD)
    rest = (low.cast("decimal(38,0)") % word).cast(U64)
    carry = ((low - rest).cast("decimal(38,0)") / word).cast("decimal(30,0)")  # a whole number
    return F.when(high + carry < word, exact((high + carry), rest))


def to_money(x: Column) -> Column:
    """The default form of an exact value, null (to be quarantined) beyond 38 digits."""
    return F.try_add(F.try_multiply(x["hi"].cast(MONEY), F.lit(WORD).cast(MONEY)), x["lo"].cast(MONEY)).cast(MONEY)
