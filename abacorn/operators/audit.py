"""Independent audit of a journal of frames: one DataFrame for each kind of violation, united.

frames: segment, offset, lsn, type, crc_ok, torn, decodes, and for transfers transfer_id, debit_account_id, credit_account_id, amount, ledger, flags,
idempotency_key; for accounts account_id, ledger, posted_debits, posted_credits; for commits expected. Frames with crc_ok false count
as records but are skipped by every other check. full_amounts=False compares only the low 64 bits of amounts, as older journals were audited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.functions.ledger import has

KINDS = ("corrupt_frame", "torn_tail", "batch_count_mismatch", "lsn_order", "conservation", "duplicate_idempotency_key", "unknown_record_type")


def _violation(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "segment", "lsn", detail.alias("detail"))


def corrupt(frames: DataFrame) -> DataFrame:
    bad = frames.where(~F.col("torn") & (~F.col("crc_ok") | ~F.col("decodes")))
    return _violation(bad, "corrupt_frame", F.when(~F.col("crc_ok"), "checksum differs").otherwise("payload does not decode"))


def torn(frames: DataFrame) -> DataFrame:
    return _violation(frames.where("torn"), "torn_tail", F.lit("frame passes the end of its segment"))


def lsn_order(frames: DataFrame) -> DataFrame:
    """An LSN not above the one before it, in the order of segment and offset: windows by segment, and the last LSN of the segments before."""
    whole = frames.where("crc_ok and not torn")
    inside = F.lag("lsn").over(W.partitionBy("segment").orderBy("offset"))
    ends = whole.groupBy("segment").agg(F.max_by("lsn", "offset").alias("last"))  # a row for each segment
    ends = ends.select("segment", F.lag("last").over(W.orderBy("segment")).alias("carried"))
    seen = whole.withColumn("before", inside).join(ends, "segment").withColumn("before", F.coalesce("before", "carried"))
    return _violation(seen.where(F.col("lsn") <= F.col("before")), "lsn_order", F.concat(F.lit("not above "), F.col("before").cast("string")))


def unknown_types(frames: DataFrame) -> DataFrame:
    return _violation(frames.where("crc_ok and not torn").where(~F.col("type").isin(S.TRANSFER, S.ACCOUNT, S.CHECKPOINT, S.COMMIT)), "unknown_record_type", F.concat(F.lit("type "), F.col("type").cast("string")))


def settlements(frames: DataFrame) -> DataFrame:
    """Transfers with left, what their hold has left before them: null where there is no such hold. Posts beyond it take nothing."""
    t = frames.where((F.col("type") == S.TRANSFER) & F.col("crc_ok") & F.col("decodes") & ~F.col("torn"))
    rows = t.groupBy("transfer_id").agg(F.array_sort(F.collect_list(F.struct("lsn", "flags", "amount"))).alias("rows"))
    kind = lambda x, b: x["flags"].bitwiseAND(F.lit(b)) != 0

    def step(a: Column, x: Column) -> Column:
        fits = x["amount"] <= a["left"]
        after = F.when(kind(x, S.POST), F.when(a["left"].isNull() | ~fits, a["left"]).when((x["amount"] == 0) | (x["amount"] == a["left"]), F.lit(None)).otherwise(a["left"] - x["amount"]))
        after = after.when(kind(x, S.VOID), F.lit(None)).when(kind(x, S.PENDING) & ~a["seen"], x["amount"]).otherwise(a["left"])
        fresh = a["seen"] | ~(kind(x, S.POST) | kind(x, S.VOID))
        return F.struct(after.cast("long").alias("left"), fresh.alias("seen"), F.concat(a["out"], F.array(F.struct(x["lsn"].alias("lsn"), a["left"].alias("left")))).alias("out"))

    start = F.struct(F.lit(None).cast("long").alias("left"), F.lit(False).alias("seen"), F.array().cast("array<struct<lsn:bigint,left:bigint>>").alias("out"))
    left = rows.select("transfer_id", F.explode(F.aggregate("rows", start, lambda a, x: step(a, x))["out"]).alias("o")).select("transfer_id", "o.lsn", "o.left")
    post, void = has(F.col("flags"), S.POST), has(F.col("flags"), S.VOID)
    bad = F.when((post | void) & F.col("left").isNull(), "settles an unknown hold").when(post & (F.col("amount") > F.col("left")), "exceeds its hold")
    return t.join(left, ["transfer_id", "lsn"]).withColumn("settle_error", bad)


def batch_counts(frames: DataFrame) -> DataFrame:
    """A commit whose count differs from the counted records since the commit before it; what fails its own check is not counted."""
    counts = F.col("crc_ok") & F.col("decodes") & ~F.col("torn") & F.col("type").isin(S.TRANSFER, S.ACCOUNT, S.CHECKPOINT)
    uncounted = settlements(frames).where("settle_error is not null").select("lsn", F.lit(True).alias("uncounted"))
    rows = frames.join(uncounted, "lsn", "left").withColumn("counted", (counts & F.col("uncounted").isNull()).cast("int"))
    return _violation(_since_commit(rows).where("n <> expected"), "batch_count_mismatch", F.concat(F.lit("expects "), F.col("expected").cast("string"), F.lit(", has "), F.col("n").cast("string")))


def _since_commit(rows: DataFrame) -> DataFrame:
    """Commits with n, the counted rows since the commit before: running counts by segment, carried over by segment totals."""
    commit = (F.col("type") == S.COMMIT) & F.col("crc_ok") & ~F.col("torn")
    running = rows.withColumn("run", F.sum("counted").over(W.partitionBy("segment").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)))
    totals = rows.groupBy("segment").agg(F.sum("counted").alias("total"))  # a row for each segment
    totals = totals.select("segment", F.coalesce(F.sum("total").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    commits = running.where(commit).join(totals, "segment").withColumn("upto", F.col("run") + F.col("base"))
    inside = F.lag("upto").over(W.partitionBy("segment").orderBy("offset"))
    ends = commits.groupBy("segment").agg(F.max("upto").alias("end"))
    ends = ends.select("segment", F.lag("end").over(W.orderBy("segment")).alias("carried"))
    return commits.withColumn("last", inside).join(ends, "segment").withColumn("n", F.col("upto") - F.coalesce("last", "carried", F.lit(0)))


def duplicates(frames: DataFrame) -> DataFrame:
    """Transfer ids that came before (plain and pending), and keys that another transfer used first."""
    t = frames.where((F.col("type") == S.TRANSFER) & F.col("crc_ok") & F.col("decodes") & ~F.col("torn"))
    opens = t.where(~has(F.col("flags"), S.POST) & ~has(F.col("flags"), S.VOID))
    by_id = W.partitionBy("transfer_id").orderBy("lsn")
    again = opens.withColumns({"nth": F.row_number().over(by_id), "first_segment": F.first("segment").over(by_id)}).where("nth > 1")
    by_key = W.partitionBy("idempotency_key").orderBy("lsn")
    shared = t.where("idempotency_key is not null").withColumn("first_id", F.first("transfer_id").over(by_key)).where("first_id <> transfer_id")
    one = _violation(again, "duplicate_idempotency_key", F.concat(F.lit("transfer already in "), F.col("first_segment").cast("string")))
    return one.union(_violation(shared, "duplicate_idempotency_key", F.lit("key used by another transfer")))


def moved(frames: DataFrame) -> DataFrame:
    """(account_id, debits, credits): what valid records move, a post from its hold's accounts."""
    s = settlements(frames).where("settle_error is null")
    post, hold, void = (has(F.col("flags"), b) for b in (S.POST, S.PENDING, S.VOID))
    by_id = W.partitionBy("transfer_id")
    of_hold = lambda c: F.max(F.when(hold, F.col(c))).over(by_id)
    amount = F.when(post, F.when(F.col("amount") == 0, F.col("left")).otherwise(F.col("amount"))).when(hold | void, 0).otherwise(F.col("amount"))
    rows = s.select("lsn", amount.alias("moves"), F.when(post, of_hold("debit_account_id")).otherwise(F.col("debit_account_id")).alias("d"), F.when(post, of_hold("credit_account_id")).otherwise(F.col("credit_account_id")).alias("c"))
    both = F.array(F.struct(F.col("d").alias("account_id"), F.col("moves").alias("debits"), F.lit(0).cast("long").alias("credits")), F.struct(F.col("c").alias("account_id"), F.lit(0).cast("long").alias("debits"), F.col("moves").alias("credits")))
    return rows.select(F.explode(both).alias("m")).select("m.*").groupBy("account_id").agg(F.sum("debits").alias("debits"), F.sum("credits").alias("credits"))


def _accounts(frames: DataFrame) -> DataFrame:
    a = frames.where((F.col("type") == S.ACCOUNT) & F.col("crc_ok") & F.col("decodes") & ~F.col("torn"))
    first = F.row_number().over(W.partitionBy("account_id").orderBy("lsn"))
    return a.withColumn("nth", first).where("nth = 1").drop("nth")


def conservation(frames: DataFrame) -> DataFrame:
    """Every breach of double entry: bad settlements, unknown accounts, foreign ledgers, debits above credits, ledgers that don't add up."""
    accounts = _accounts(frames).select("account_id", F.col("ledger").alias("own_ledger"), "posted_debits", "posted_credits", "segment", "lsn")
    born = _violation(accounts.where("posted_debits > posted_credits"), "conservation", F.lit("account created with debits above credits"))
    s = settlements(frames)
    out = born.union(_violation(s.where("settle_error is not null"), "conservation", F.col("settle_error")))
    opens = s.where(~has(F.col("flags"), S.POST) & ~has(F.col("flags"), S.VOID))
    side = lambda p: accounts.select(F.col("account_id").alias(f"{p}_account_id"), F.col("own_ledger").alias(f"{p}_ledger"), F.col("lsn").alias(f"{p}_lsn"))
    known = opens.join(side("debit"), "debit_account_id", "left").join(side("credit"), "credit_account_id", "left")
    there = lambda p: F.col(f"{p}_lsn").isNotNull() & (F.col(f"{p}_lsn") < F.col("lsn"))
    for p in ("debit", "credit"):
        out = out.union(_violation(known.where(~there(p)), "conservation", F.lit(f"{p}s an unknown account")))
    foreign = (F.col("debit_ledger") != F.col("ledger")) | (F.col("credit_ledger") != F.col("ledger"))
    out = out.union(_violation(known.where(there("debit") & there("credit") & foreign), "conservation", F.lit("ledger differs from its accounts'")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    final = accounts.join(moved(frames), "account_id", "left").withColumns({"d": F.col("posted_debits") + zero("debits"), "c": F.col("posted_credits") + zero("credits")})
    nowhere = {"segment": F.lit(None).cast(frames.schema["segment"].dataType), "lsn": F.lit(0).cast("long")}
    out = out.union(_violation(final.where("d > c").withColumns(nowhere), "conservation", F.lit("account ends with debits above credits")))
    ledgers = final.groupBy("own_ledger").agg(F.sum(F.col("posted_credits") - F.col("posted_debits")).alias("injected"), F.sum(F.when(F.col("d") <= F.col("c"), F.col("c") - F.col("d")).otherwise(0)).alias("total"))
    return out.union(_violation(ledgers.where("injected <> total").withColumns(nowhere), "conservation", F.concat(F.lit("ledger "), F.col("own_ledger").cast("string"), F.lit(" differs from its injected credits"))))


def violations(frames: DataFrame) -> DataFrame:
    """kind, segment, lsn, detail of every violation."""
    parts = [corrupt(frames), torn(frames), batch_counts(frames), lsn_order(frames), conservation(frames), duplicates(frames), unknown_types(frames)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(frames: DataFrame) -> DataFrame:
    """One row: segments, records, batches, accounts, transfers, violations, valid."""
    whole = F.col("crc_ok") & ~F.col("torn")
    n = lambda t: F.count_if(whole & (F.col("type") == t))
    counts = frames.agg(F.count_distinct("segment").alias("segments"), F.count_if(~F.col("torn")).alias("records"), n(S.COMMIT).alias("batches"), n(S.ACCOUNT).alias("accounts"), n(S.TRANSFER).alias("transfers"))
    return counts.crossJoin(violations(frames).agg(F.count("*").alias("violations"))).withColumn("valid", F.col("violations") == 0)  # one row each
