"""State and history from an accepted journal, all DataFrame algebra.

Journal columns: lsn, transfer_id, debit_account_id, credit_account_id, amount, ledger, flags, ts_ns, timeout_ns, batch_id. Posts and voids
name their hold by transfer_id and inherit its accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions.ledger import available, balance, deadline, has

STATE = ("posted_debits", "posted_credits", "pending_debits", "pending_credits")


def settled(journal: DataFrame, clock: Column | None = None) -> DataFrame:
    """Every record with its hold and what it moves: pending and posted change per record, one pass over the records of each hold.

    A post of amount 0 settles all that is left, a void releases it. clock: holds whose deadline is at or before it are released too.
    Plain records need no hold and take no part in the pass.
    """
    by_id = W.partitionBy("transfer_id")
    before = by_id.orderBy("lsn").rowsBetween(W.unboundedPreceding, -1)
    hold, post, void = (has(F.col("flags"), b) for b in (S.PENDING, S.POST, S.VOID))
    whole = lambda c: F.max(F.when(hold, F.col(c))).over(by_id)
    out = journal.where(hold | post | void)
    out = out.withColumns({"hold_amount": whole("amount"), "hold_debit": whole("debit_account_id"), "hold_credit": whole("credit_account_id"), "hold_deadline": F.max(F.when(hold, deadline(F.col("ts_ns"), F.col("timeout_ns")))).over(by_id)})
    # a post of 0, or a void, leaves nothing to a later record
    spent = F.coalesce(F.sum(F.when(post, F.col("amount"))).over(before), F.lit(0))
    ended = F.coalesce(F.max(F.when(void | (post & (F.col("amount") == 0)), 1)).over(before), F.lit(0)) == 1
    left = F.when(ended, 0).otherwise(F.col("hold_amount") - spent)
    out = out.withColumn("left_before", F.when(post | void, left).cast("long"))
    moved = F.when(post, F.when(F.col("amount") == 0, F.col("left_before")).otherwise(F.col("amount")))
    out = out.withColumns(
        {
            "posted": F.when(post, moved).otherwise(0).cast("long"),
            "pending": F.when(hold, F.col("amount")).when(post, -moved).otherwise(-F.col("left_before")).cast("long"),
            "debit": F.when(hold, F.col("debit_account_id")).otherwise(F.col("hold_debit")),
            "credit": F.when(hold, F.col("credit_account_id")).otherwise(F.col("hold_credit")),
        }
    )
    plain = journal.where(~(hold | post | void)).withColumns({"posted": F.col("amount").cast("long"), "pending": F.lit(0).cast("long"), "debit": F.col("debit_account_id"), "credit": F.col("credit_account_id")})
    out = out.unionByName(plain, allowMissingColumns=True)
    return out if clock is None else out.withColumn("expired", hold & (F.col("hold_deadline") <= clock))


def legs(journal: DataFrame) -> DataFrame:
    """Two rows for each record, one for each account that it moves."""
    both = F.array(
        F.struct(F.col("debit").alias("account_id"), F.lit("debit").alias("side"), F.col("posted").alias("posted_debits"), F.lit(0).cast("long").alias("posted_credits"), F.col("pending").alias("pending_debits"), F.lit(0).cast("long").alias("pending_credits")),
        F.struct(F.col("credit").alias("account_id"), F.lit("credit").alias("side"), F.lit(0).cast("long").alias("posted_debits"), F.col("posted").alias("posted_credits"), F.lit(0).cast("long").alias("pending_debits"), F.col("pending").alias("pending_credits")),
    )
    return settled(journal).select("lsn", "transfer_id", "ledger", "ts_ns", F.explode(both).alias("leg")).select("lsn", "transfer_id", "ledger", "ts_ns", "leg.*")


def balances(accounts: DataFrame, journal: DataFrame, clock: int | None = None) -> DataFrame:
    """The state of every account after the journal, without the holds that expired by the clock (default: that of the last record).

    A sum over plain records, and over what the holds' posts moved and their open rests: one aggregation by hold, one by account, no window.
    balance and available are null where an invariant breaks.
    """
    zero, open_ = F.lit(0).cast("long"), F.when(F.col("status") == "open", F.col("left")).otherwise(0).cast("long")
    plain = journal.where(F.col("flags").bitwiseAND(F.lit(S.PENDING | S.POST | S.VOID)) == 0)
    moves = plain.select("debit_account_id", "credit_account_id", F.col("amount").cast("long").alias("posted"), zero.alias("pending"))
    moves = moves.unionByName(_holds(journal, clock).select("debit_account_id", "credit_account_id", "posted", open_.alias("pending")))
    debit = F.struct(F.col("debit_account_id").alias("account_id"), *_state(F.col("posted"), zero, F.col("pending"), zero))
    credit = F.struct(F.col("credit_account_id").alias("account_id"), *_state(zero, F.col("posted"), zero, F.col("pending")))
    moved = moves.select(F.explode(F.array(debit, credit)).alias("x")).groupBy("x.account_id").agg(*(F.sum(f"x.{c}").alias(f"m_{c}") for c in STATE))
    out = accounts.join(moved, "account_id", "left")
    out = out.withColumns({c: (F.col(c) + F.coalesce(F.col(f"m_{c}"), F.lit(0))).cast("long") for c in STATE})
    return with_balances(out.drop(*(f"m_{c}" for c in STATE)))


def _state(*values: Column) -> list[Column]:
    return [v.alias(c) for v, c in zip(values, STATE)]


def with_balances(accounts: DataFrame) -> DataFrame:
    pd, pc, nd, nc = map(F.col, STATE)
    error = F.when(balance(pd, pc).isNull() | available(pd, pc, nd, nc).isNull(), "InvariantViolation")
    return accounts.withColumns({"balance": balance(pd, pc).cast("long"), "available": available(pd, pc, nd, nc).cast("long"), "error_code": error})


def holds(journal: DataFrame, clock: int | None = None) -> DataFrame:
    """Every hold with what is left of it and its status as of a clock (default: that of the last record)."""
    return _holds(journal, clock).drop("posted")


def _holds(journal: DataFrame, clock: int | None) -> DataFrame:
    """The columns of holds, and posted, what the posts of a hold moved in all."""
    hold, post, void = (has(F.col("flags"), b) for b in (S.PENDING, S.POST, S.VOID))
    as_of = F.lit(clock) if clock is not None else F.max("ts_ns")
    each = journal.where(hold | post | void).groupBy("transfer_id").agg(
        F.max(F.when(hold, F.col("amount"))).alias("hold_amount"), F.max(F.when(hold, F.col("debit_account_id"))).alias("debit_account_id"), F.max(F.when(hold, F.col("credit_account_id"))).alias("credit_account_id"),
        F.max(F.when(hold, deadline(F.col("ts_ns"), F.col("timeout_ns")))).cast("long").alias("deadline_ns"),
        F.sum(F.when(post, F.col("amount")).otherwise(0)).alias("part_posted"), F.max(F.when(post & (F.col("amount") == 0), 1).otherwise(0)).alias("all_posted"), F.max(F.when(void, 1).otherwise(0)).alias("voided"),
    )
    last = journal.agg(as_of.alias("clock_ns"))
    whole = F.col("all_posted") == 1
    left = F.when(whole | (F.col("voided") == 1), 0).otherwise(F.col("hold_amount") - F.col("part_posted")).cast("long")
    out = each.withColumns({"left": left, "posted": F.when(whole, F.col("hold_amount")).otherwise(F.col("part_posted")).cast("long")}).crossJoin(F.broadcast(last))  # one row
    status = F.when(F.col("voided") == 1, "voided").when(F.col("left") == 0, "posted").when(F.col("deadline_ns") <= F.col("clock_ns"), "expired").otherwise("open")
    return out.withColumn("status", status).select("transfer_id", "debit_account_id", "credit_account_id", "hold_amount", "left", "deadline_ns", "status", "posted")


#: LSNs of one run: windows over an account's records go by runs, and totals of the runs before are carried into them.
RUN = 1 << 20


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    """(account_id, run, before): the sum of value over the runs of the account before this one."""
    sums = rows.groupBy("account_id", "run").agg(F.sum(value).alias("here"))
    before = F.sum("here").over(W.partitionBy("account_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    return sums.select("account_id", "run", F.coalesce(before, F.lit(0)).alias("before"))


def running_balances(accounts: DataFrame, journal: DataFrame) -> DataFrame:
    """Each account's posted balance after each of its records. A sink's records are windows of a run of LSNs each, not one of all."""
    delta = (F.col("posted_credits") - F.col("posted_debits")).alias("delta")
    moved = legs(journal).select("account_id", "lsn", delta, F.floor(F.col("lsn") / RUN).alias("run"))
    order = W.partitionBy("account_id", "run").orderBy("lsn").rowsBetween(W.unboundedPreceding, 0)
    inside = moved.withColumn("upto", F.sum("delta").over(order)).join(_carried(moved, F.col("delta")), ["account_id", "run"])
    opening = accounts.select("account_id", F.col("posted_credits").alias("opening"))
    return inside.join(opening, "account_id").select("account_id", "lsn", "delta", (F.col("opening") + F.col("before") + F.col("upto")).alias("running_balance"))


def latest(journal: DataFrame) -> DataFrame:
    """The latest version of each transfer: a post or void replaces its hold's row and inherits ledger and accounts that it leaves at zero."""
    named = settled(journal)
    inherit = lambda c, h: F.when(F.col(c) == 0, F.coalesce(h, F.col(c))).otherwise(F.col(c))
    version = F.struct("lsn", _named("debit").alias("debit_account_id"), _named("credit").alias("credit_account_id"), "amount", inherit("ledger", F.max("ledger").over(W.partitionBy("transfer_id"))).alias("ledger"), "flags", "ts_ns")
    return named.select("transfer_id", version.alias("v")).groupBy("transfer_id").agg(F.max_by("v", "v.lsn").alias("v")).select("transfer_id", "v.*")


def _named(side: str) -> Column:
    """The account that a record names on a side: its own, or its hold's where it leaves it at zero."""
    return F.when(F.col(f"{side}_account_id") == 0, F.coalesce(F.col(f"hold_{side}"), F.lit(0).cast("long"))).otherwise(F.col(f"{side}_account_id"))


def history(journal: DataFrame) -> DataFrame:
    """(account_id, lsn, transfer_id, position): what each account's history lists, in order of arrival; one leg where both sides are one account."""
    named = settled(journal).select("lsn", "transfer_id", F.explode(F.array_distinct(F.array(_named("debit"), _named("credit")))).alias("account_id"))
    # equal rows are told by their neighbour in the sort that places them; a hash table of all rows would grow with a task's input
    order, row = W.partitionBy("account_id", "run").orderBy("lsn", "transfer_id"), F.struct("lsn", "transfer_id")
    each = named.withColumn("run", F.floor(F.col("lsn") / RUN)).select("account_id", "lsn", "transfer_id", "run")
    once = each.withColumn("again", F.lag(row).over(order).eqNullSafe(row)).where("not again").drop("again")
    nth = F.row_number().over(order)
    placed = once.withColumn("nth", nth).join(_carried(once, F.lit(1)), ["account_id", "run"])
    return placed.select("account_id", "lsn", "transfer_id", (F.col("before") + F.col("nth")).cast("int").alias("position"))


def page(journal: DataFrame, account_id, after=None, limit: int = S.PAGE) -> DataFrame:
    """A page of one account's history after a cursor: an unknown cursor starts from the beginning, limit <= 0 means everything.

    The account's own records and the posts and voids of its holds are picked before anything is placed; versions are built for the page alone.
    """
    mine = (F.col("debit_account_id") == account_id) | (F.col("credit_account_id") == account_id)
    held = journal.where(mine & has(F.col("flags"), S.PENDING)).select("transfer_id").distinct()
    settling = journal.where((has(F.col("flags"), S.POST) | has(F.col("flags"), S.VOID)) & ~mine).join(held, "transfer_id", "left_semi")
    own = history(journal.where(mine).unionByName(settling)).where(F.col("account_id") == account_id)
    start = own.where(F.col("transfer_id") == F.lit(after)).agg(F.coalesce(F.min("position"), F.lit(0)).alias("start"))
    rest = own.crossJoin(F.broadcast(start)).where(F.col("position") > F.col("start")).drop("start")  # one row
    rest = rest if limit <= 0 else rest.orderBy("position").limit(limit)
    ids = rest.select("transfer_id").distinct()
    return rest.join(latest(journal.join(ids, "transfer_id", "left_semi")).drop("lsn"), "transfer_id")


def conservation(accounts: DataFrame, after: DataFrame) -> DataFrame:
    """For each ledger, credits injected at creation against final balances; broken accounts are left out of the latter."""
    injected = accounts.groupBy("ledger").agg(F.sum(F.col("posted_credits") - F.col("posted_debits")).alias("injected"))
    final = after.where(F.col("posted_debits") <= F.col("posted_credits")).groupBy("ledger").agg(F.sum(F.col("posted_credits") - F.col("posted_debits")).alias("final"))
    return injected.join(final, "ledger", "full_outer").select("ledger", "injected", F.coalesce("final", F.lit(0)).alias("final"), (F.coalesce("final", F.lit(0)) == F.coalesce("injected", F.lit(0))).alias("conserved"))
