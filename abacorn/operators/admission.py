"""Which submitted rows are accepted: stateless rules as expressions, the ordered fold, and the fold per account where that suffices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions.ledger import account_error, has, kinds, unknown_flags
from abacorn.operators import journal
from abacorn.operators.fold import Account, Hold, Ledger, admit
from abacorn.operators.graph import components

#: What a fold needs of an account, and of a hold that is open.
ACCOUNT_FIELDS = ("currency", "ledger", "flags", "posted_debits", "posted_credits", "pending_debits", "pending_credits")
HOLD_COLUMNS = {"transfer_id": "long", "debit_account_id": "long", "credit_account_id": "long", "left": "long", "ledger": "long", "deadline_ns": "long"}
OUTCOMES = "batch_id long, idx int, transfer_id long, ledger long, ok boolean, error_code string, error_subject string"


def static_error(t: DataFrame, accounts: DataFrame) -> DataFrame:
    """t with error_code of the first stateless rule it breaks, in the order of evaluation; accounts is the small side of two joins."""
    side = lambda p: accounts.select(F.col("account_id").alias(f"{p}_account_id"), F.col("currency").alias(f"{p}_currency"), F.col("ledger").alias(f"{p}_ledger"), F.col("flags").alias(f"{p}_flags"))
    joined = t.join(side("debit"), "debit_account_id", "left").join(side("credit"), "credit_account_id", "left")
    flags = F.col("flags")
    settles = has(flags, S.POST) | has(flags, S.VOID)
    rules = F.when(unknown_flags(flags) | (kinds(flags) > 1), "InvalidTransferFlags")
    accounts_ = (
        F.when(F.col("amount") == 0, "ZeroAmount").when(F.col("debit_account_id") == F.col("credit_account_id"), "SelfTransfer")
        .when(F.col("debit_ledger").isNull() | F.col("credit_ledger").isNull(), "AccountNotFound").when(F.col("debit_currency") != F.col("credit_currency"), "CurrencyMismatch")
        .when((F.col("debit_ledger") != F.col("ledger")) | (F.col("credit_ledger") != F.col("ledger")), "LedgerMismatch")
        .otherwise(F.coalesce(account_error(F.col("debit_flags"), F.col("debit_account_id")), account_error(F.col("credit_flags"), F.col("credit_account_id"))))
    )
    return joined.select(*t.columns, rules.when(~settles, accounts_).alias("error_code"))


def create_errors(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New accounts (batch_id, idx, account_id, balances) with error_code: debits above credits, or an id that exists or came earlier."""
    first = F.row_number().over(W.partitionBy("account_id", "valid").orderBy("batch_id", "idx"))
    valid = new.withColumn("valid", F.col("posted_debits") <= F.col("posted_credits"))
    known = existing.select("account_id", F.lit(True).alias("known"))
    out = valid.withColumn("nth", first).join(known, "account_id", "left")
    code = F.when(~F.col("valid"), "InvariantViolation").when(F.col("known") | (F.col("nth") > 1), "DuplicateAccountID")
    return out.select(*new.columns, code.alias("error_code"))


def batch_errors(items: DataFrame) -> DataFrame:
    """Batches of more items than a client batch may have."""
    return items.groupBy("batch_id").agg(F.count("*").alias("items")).withColumn("error_code", F.when(F.col("items") > S.BATCH_LIMIT, "BatchTooLarge"))


def chains(items: DataFrame) -> DataFrame:
    """items (batch_id, idx, linked) with chain_no in the batch, chain_size and chain_open: a chain is a run of linked rows and the row after it."""
    order = W.partitionBy("batch_id").orderBy("idx")
    chain = W.partitionBy("batch_id", "chain_no")
    starts = F.when(F.coalesce(F.lag("linked").over(order), F.lit(False)), 0).otherwise(1)
    out = items.withColumn("chain_no", F.sum(starts).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumns({"chain_size": F.count("*").over(chain), "chain_open": F.max_by("linked", "idx").over(chain)})


def chain_outcomes(items: DataFrame) -> DataFrame:
    """items (batch_id, idx, linked, error_code: of the leg alone) with outcome: the first error of a chain stands, its other legs fail with it."""
    chain = W.partitionBy("batch_id", "chain_no")
    c = chains(items)
    c = c.withColumns({"first_bad": F.min(F.when(F.col("error_code").isNotNull(), F.col("idx"))).over(chain), "last": F.max("idx").over(chain)})
    failing = F.col("first_bad").isNotNull()
    outcome = F.when(failing & (F.col("idx") == F.col("first_bad")), F.col("error_code")).when(failing, "LinkedChainFailed").when(F.col("chain_open") & (F.col("idx") == F.col("last")), "LinkedChainOpen").when(F.col("chain_open"), "LinkedChainFailed")
    return c.withColumn("outcome", outcome).drop("first_bad", "last")


@dataclass
class State:
    """What admission knows after a journal: open holds (HOLD_COLUMNS), every id accepted so far (transfer_id), and the clock."""

    holds: DataFrame
    ids: DataFrame
    clock_ns: int


def restore(accounts: DataFrame, journal_: DataFrame) -> tuple[DataFrame, State]:
    """Replay: the accounts with their balances after the journal, and the state from which admit_batches goes on."""
    clock = int(journal_.agg(F.max("ts_ns")).first()[0] or 0)
    ledgers = journal_.where(has(F.col("flags"), S.PENDING)).groupBy("transfer_id").agg(F.max("ledger").alias("ledger"))
    open_ = journal.holds(journal_).where("status = 'open'").join(ledgers, "transfer_id").select(*HOLD_COLUMNS)
    settles = has(F.col("flags"), S.POST) | has(F.col("flags"), S.VOID)
    return journal.balances(accounts, journal_), State(open_, journal_.where(~settles).select("transfer_id").distinct(), clock)


def _accounts(frame: pd.DataFrame) -> dict:
    return {int(row.account_id): Account(**{n: (str if n == "currency" else int)(getattr(row, n)) for n in ACCOUNT_FIELDS}) for row in frame.itertuples()}


def run_batches(ledger: Ledger, frame: pd.DataFrame) -> Iterator[tuple]:
    """Outcome rows of the batches of one ledger, in the order of batch and position; frame: columns of the submitted rows and now_ns."""
    frame = frame.sort_values(["batch_id", "idx"], kind="stable")
    names = [c for c in frame.columns if c != "currency"]
    rows = [dict(zip(names, values)) for values in zip(*(frame[c].tolist() for c in names))]
    start = 0
    while start < len(rows):
        end, batch = start, rows[start]["batch_id"]
        while end < len(rows) and rows[end]["batch_id"] == batch:
            end += 1
        items = rows[start:end]
        for item, error in zip(items, admit(ledger, items, max(r["now_ns"] for r in items))):
            code, subject = error or (None, None)
            yield batch, item["idx"], item["transfer_id"], item["ledger"], error is None, code, None if subject is None else str(subject)
        start = end


def admit_batches(submitted: DataFrame, accounts: DataFrame, state: State | None = None, buckets: int | None = None) -> DataFrame:
    """The ordered fold: outcomes of submitted rows, over all ledgers; state: what earlier batches left behind (accounts then carry their balances).

    submitted: batch_id, idx, transfer_id, debit_account_id, credit_account_id, amount, ledger, flags, timeout_ns, now_ns. Decisions depend on each
    other only through accounts that debit, repeated ids, holds and chains; parts of the rows that share none of these are folded apart, dealt to
    buckets (by default four for each shuffle partition). A part is sequential by definition. Accounts that are only credited, as sinks are, join no
    parts; their credits count nowhere unless they are near the limit of money.
    """
    spark = submitted.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = submitted.groupBy("batch_id").agg(F.count("*").alias("items"), F.max("now_ns").alias("now"))
    large = sizes.where(F.col("items") > S.BATCH_LIMIT).select("batch_id", "items")
    refused = submitted.join(large, "batch_id").select("batch_id", "idx", "transfer_id", "ledger", F.lit(False).alias("ok"), F.lit("BatchTooLarge").alias("error_code"), F.col("items").cast("string").alias("error_subject"))
    clocks = _running_clock(sizes.where(F.col("items") <= S.BATCH_LIMIT).select("batch_id", "now"), state.clock_ns if state else 0)
    # rows of refused batches may join parts that are apart without them, which changes no outcome
    keyed, held = partition_key(submitted.drop("now_ns"), accounts, state)
    dealt = keyed.join(clocks, "batch_id").withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int"))
    again = (F.col("bucket") + F.lit(0)).cast("int").alias("bucket")  # a column of its own, for the two sides of the cogroup
    needed = dealt.select(again, F.explode(F.array("debit_account_id", "credit_account_id")).alias("account_id"))
    known = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in HOLD_COLUMNS.items()) + ", bucket int")
    if held is not None:
        known = held.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int")).drop("part")
        needed = needed.union(known.select("bucket", F.explode(F.array("debit_account_id", "credit_account_id"))))
    book = accounts.join(needed.distinct(), "account_id").select("bucket", "account_id", *ACCOUNT_FIELDS)
    parts = known.select("bucket", F.lit(True).alias("is_hold"), *HOLD_COLUMNS, *(F.lit(None).cast("string" if c == "currency" else "long").alias(c) for c in ("account_id", *ACCOUNT_FIELDS) if c not in HOLD_COLUMNS))
    book = parts.unionByName(book.withColumn("is_hold", F.lit(False)), allowMissingColumns=True)

    def fold(_key: tuple, items: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ledger = Ledger(_accounts(held[~held["is_hold"]]), ids=set(items.loc[items["known"], "transfer_id"]))
        for h in held[held["is_hold"]].itertuples():
            ledger.put(int(h.transfer_id), Hold(int(h.debit_account_id), int(h.credit_account_id), int(h.left), int(h.ledger), None if pd.isna(h.deadline_ns) else int(h.deadline_ns)))
        return pd.DataFrame(list(run_batches(ledger, items.drop(columns=["bucket", "part", "known"]))), columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return dealt.groupBy("bucket").cogroup(book.groupBy("bucket")).applyInPandas(fold, OUTCOMES).union(refused)


def _running_clock(batches: DataFrame, least: int, width: int = 4096) -> DataFrame:
    """batches (batch_id, now) with now_ns, the highest now so far: windows over runs of width batches, and what the runs before carry."""
    run = F.floor(F.col("batch_id") / width)
    order = W.partitionBy("run").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    carried = batches.groupBy(run.alias("run")).agg(F.max("now").alias("top")).select("run", F.max("top").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = batches.withColumn("run", run).withColumn("top", F.max("now").over(order))
    return inside.join(carried, "run").select("batch_id", F.greatest("top", "carried", F.lit(least)).cast("long").alias("now_ns"))


def partition_key(rows: DataFrame, accounts: DataFrame, state: State | None = None) -> tuple[DataFrame, DataFrame | None]:
    """rows with part, equal for rows whose decisions may depend on each other, and known (the id was accepted before); and the open holds with part."""
    node = lambda kind, *c: F.xxhash64(F.lit(kind), *c)
    own = lambda settles: F.when(settles, node("id", "transfer_id")).otherwise(node("account", "debit_account_id"))
    settles = has(F.col("flags"), S.POST) | has(F.col("flags"), S.VOID)
    links = rows.select("batch_id", "idx", has(F.col("flags"), S.LINKED).alias("linked"))
    chained = chains(links).where("chain_size > 1").select("batch_id", "idx", F.col("chain_no").alias("chain"))
    repeated = rows.groupBy("transfer_id").count().where("count > 1").select("transfer_id")
    debits = rows.where(~settles).select(F.col("debit_account_id").alias("account_id"))
    near = accounts.where((F.col("posted_credits") > 10**37) | (F.col("pending_credits") > 10**37)).select("account_id") if dict(accounts.dtypes)["posted_credits"].startswith("decimal") else None
    out = rows.withColumn("known", F.lit(False))
    if state is not None:
        repeated = repeated.union(state.holds.select("transfer_id")).distinct()
        debits = debits.union(state.holds.select("debit_account_id"))
        out = rows.join(state.ids.select("transfer_id").distinct().withColumn("known", F.lit(True)), "transfer_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    debits = (debits if near is None else debits.union(near)).distinct()
    # where no credit may be contested, no id comes again and no row is linked, nothing joins two rows; this asks less than the edges themselves
    credits = rows.where(~settles).select(F.col("credit_account_id").alias("account_id"))
    if state is not None:
        credits = credits.union(state.holds.select("credit_account_id"))
    linked = links.where("linked").select(F.col("batch_id").cast("long"))
    if credits.distinct().join(debits, "account_id", "left_semi").union(repeated).union(linked).isEmpty():
        alone = out.withColumn("part", own(settles)).select(*rows.columns, "known", "part")
        return alone, state and state.holds.select(*HOLD_COLUMNS).withColumn("part", node("account", "debit_account_id"))
    contested = debits.select(F.col("account_id").alias("credit_account_id"), F.lit(True).alias("contested"))
    out = out.join(contested, "credit_account_id", "left").join(repeated.withColumn("again", F.lit(True)), "transfer_id", "left").join(chained, ["batch_id", "idx"], "left")
    more = F.array(
        F.when(~settles & F.col("contested"), node("account", "credit_account_id")), F.when(F.col("again"), node("id", "transfer_id")), F.when(F.col("chain").isNotNull(), node("chain", "batch_id", "chain"))
    )
    out = out.withColumn("own", own(settles)).withColumn("more", F.array_compact(more)).select(*rows.columns, "known", "own", "more")
    edges = out.select(F.col("own").alias("a"), F.explode("more").alias("b")).where("a != b")
    held = None
    if state is not None:
        held = state.holds.select(*HOLD_COLUMNS).withColumn("own", node("account", "debit_account_id"))
        both = held.join(contested, "credit_account_id", "left").select(F.col("own").alias("a"), F.array_compact(F.array(node("id", "transfer_id"), F.when(F.col("contested"), node("account", "credit_account_id")))).alias("more"))
        edges = edges.union(both.select("a", F.explode("more").alias("b")).where("a != b"))
    roots = components(edges).withColumnRenamed("node", "own")
    labelled = lambda df: df.join(roots, "own", "left").withColumn("part", F.coalesce("root", "own")).drop("own", "root", "more")
    return labelled(out), held and labelled(held)


def admit_to_sinks(submitted: DataFrame, opening: Column, order: Column) -> DataFrame:
    """The fold where every account only debits and sinks never do: a left fold per debit account, in the JVM, spread over all accounts.

    submitted: transfer_id, debit_account_id, amount and the columns of opening and order. Returns debit_account_id, left, accepted ids.
    """
    rows = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col("transfer_id").alias("id"), F.col("amount").alias("amount"))))
    start = F.struct(F.col("opening").alias("left"), F.array().cast("array<bigint>").alias("ids"))
    fits = lambda a, x: a["left"] >= x["amount"]
    step = lambda a, x: F.struct(F.when(fits(a, x), a["left"] - x["amount"]).otherwise(a["left"]).alias("left"), F.when(fits(a, x), F.concat(a["ids"], F.array(x["id"]))).otherwise(a["ids"]).alias("ids"))
    grouped = submitted.groupBy("debit_account_id").agg(F.max(opening).alias("opening"), rows.alias("rows"))
    return grouped.select("debit_account_id", F.aggregate("rows", start, lambda a, x: step(a, x)).alias("r")).select("debit_account_id", F.col("r.left").alias("left"), F.col("r.ids").alias("accepted"))


def role_error(is_follower: Column) -> Column:
    """A follower takes no writes, whatever they are."""
    return F.when(is_follower, "NotLeader")


def dry_run(submitted: DataFrame, state: DataFrame) -> DataFrame:
    """submitted with the error_code that each row would get alone against the current state; nothing is kept, so no order matters.

    state: accounts with balance and available, null where an invariant breaks. Posts and voids are not judged.
    """
    judged = static_error(submitted, state)
    funds = state.select(F.col("account_id").alias("debit_account_id"), "balance", "available")
    own = F.when(has(F.col("flags"), S.PENDING), F.col("available")).otherwise(F.col("balance"))
    rich = F.when(own.isNull(), "InvariantViolation").when(own < F.col("amount"), "InsufficientFunds")
    settles = has(F.col("flags"), S.POST) | has(F.col("flags"), S.VOID)
    out = judged.join(funds, "debit_account_id", "left").withColumn("error_code", F.coalesce("error_code", F.when(~settles, rich)))
    return out.select(*submitted.columns, "error_code")


def batch_clock(batches: DataFrame, width: int = 4096) -> DataFrame:
    """batches (batch_id, now_ns) with clock_ns = max(now, last clock + 1): the highest of now less its place so far, plus the place. A row for each batch.

    Places and maxima are windows over runs of width batch ids, and what the runs before carry; a window without a partition sees one row a run.
    """
    numbered = batches.withColumn("run", F.floor(F.col("batch_id") / width))
    inside, runs = W.partitionBy("run").orderBy("batch_id"), W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    counts = numbered.groupBy("run").agg(F.count("*").alias("n")).select("run", F.coalesce(F.sum("n").over(runs), F.lit(0)).alias("places"))
    placed = numbered.join(counts, "run").withColumn("place", F.col("places") + F.row_number().over(inside))
    least = F.col("now_ns") - F.col("place")
    tops = placed.groupBy("run").agg(F.max(least).alias("top")).select("run", F.max("top").over(runs).alias("top"))
    upto = F.max(least).over(inside.rowsBetween(W.unboundedPreceding, 0))
    clocked = placed.withColumn("upto", upto).join(tops, "run")
    return clocked.withColumn("clock_ns", F.greatest("upto", "top") + F.col("place")).select(*batches.columns, "clock_ns")
