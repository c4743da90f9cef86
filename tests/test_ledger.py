"""Money, audit and streaming, and every query against its SQL."""

import pickle
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from abacorn.functions import money as M
from abacorn.operators import admission, audit, idempotency, journal
from abacorn.operators.graph import components
from abacorn.plans import log_queries  # noqa: F401  registers its queries
from abacorn.plans import queries as Q
from abacorn.streaming.admission import admit_stream, append_once, fresh_keys

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(v):
    return None if v is None or v != v else round(float(v), 6) if not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = sorted((tuple(same(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    r = duck.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(same(row[i]) for i in at) for row in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == Q.STATE_COLUMNS and set(entry.oracle_sql()) <= set(entry.queries())


TOP = 2**128 - 1


@pytest.mark.parametrize("value", [0, 1, 2**64 - 1, 2**64, 10**38 - 1, TOP])
def test_exact_money(spark, value):
    b = F.lit(value.to_bytes(16, "big"))
    x = M.exact_from_binary(b)
    one = M.exact_from_binary(F.lit((1).to_bytes(16, "big")))
    row = spark.range(1).select(x.alias("x"), M.exact_to_binary(x).alias("b"), M.exact_add(x, one).alias("up"), M.exact_subtract(x, one).alias("down"), M.to_money(x).alias("m")).first()
    whole = lambda s: None if s is None else int(s["hi"]) * 2**64 + int(s["lo"])
    assert whole(row["x"]) == value and bytes(row["b"]) == value.to_bytes(16, "big")
    assert whole(row["up"]) == (value + 1 if value < TOP else None) and whole(row["down"]) == (value - 1 if value else None)
    assert (None if row["m"] is None else int(row["m"])) == (value if value < 10**38 else None)


def test_exact_sum(spark):
    rows = spark.createDataFrame([((2**64 - 1).to_bytes(16, "big"),)] * 3, "b binary")
    s = rows.agg(M.exact_sum(M.exact_from_binary(F.col("b"))).alias("s")).first()["s"]
    assert int(s["hi"]) * 2**64 + int(s["lo"]) == 3 * (2**64 - 1)


SCHEMA = "segment long, offset long, lsn long, type int, crc_ok boolean, torn boolean, decodes boolean, expected int, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, idempotency_key long, account_id long, posted_debits long, posted_credits long"


def frame(lsn, kind, **more):
    base = dict.fromkeys((c.split()[0] for c in SCHEMA.split(", ")), None) | {"segment": 1, "offset": lsn, "lsn": lsn, "type": kind, "crc_ok": True, "torn": False, "decodes": True}
    return tuple((base | more).values())


def account(lsn, key, credits=0, debits=0, ledger=0):
    return frame(lsn, 2, account_id=key, posted_credits=credits, posted_debits=debits, ledger=ledger)


def move(lsn, key, d, c, amount, flags=0, idem=None, ledger=0):
    return frame(lsn, 1, transfer_id=key, debit_account_id=d, credit_account_id=c, amount=amount, flags=flags, idempotency_key=idem, ledger=ledger)


def kinds(spark, *rows):
    return sorted(r["kind"] for r in audit.violations(spark.createDataFrame(list(rows), SCHEMA)).collect())


def test_audit_golden(spark):
    a, b, commit = account(1, 1, 1000), account(2, 2), lambda lsn, n: frame(lsn, 4, expected=n)
    assert kinds(spark, a, b, commit(3, 2), move(4, 10, 1, 2, 10), move(5, 20, 1, 2, 20), commit(6, 2), move(7, 30, 1, 2, 30), commit(8, 1)) == []
    held = [move(4, 10, 1, 2, 400, 1), move(5, 10, 0, 0, 150, 2), move(6, 10, 0, 0, 250, 2), commit(7, 3)]
    assert kinds(spark, a, b, commit(3, 2), *held) == []
    assert kinds(spark, a, b, commit(3, 2), move(4, 1, 1, 2, 5, idem=9), move(5, 2, 1, 2, 5, idem=9), commit(6, 2)) == ["duplicate_idempotency_key"]
    assert kinds(spark, move(1, 1, 77, 78, 5)) == ["conservation", "conservation"]
    assert kinds(spark, a, b, commit(3, 2), move(4, 10, 0, 0, 5, 2), commit(5, 1)) == ["batch_count_mismatch", "conservation"]
    assert kinds(spark, a, b, commit(3, 1)) == ["batch_count_mismatch"]
    assert kinds(spark, a, b, frame(2, 9, offset=3)) == ["lsn_order", "unknown_record_type"]
    assert kinds(spark, a, move(2, 5, 1, 1, 1, ledger=3)) == ["conservation"]
    assert kinds(spark, a, b, move(3, 5, 1, 2, 2000)) == ["conservation"] * 2  # the account's end, and so the ledger's


def test_stream_equals_batch(spark, tmp_path):
    accounts = spark.createDataFrame([(i, "USD", 0, 0, 0, 1000, 0, 0) for i in range(4)], "account_id long, currency string, ledger long, flags long, posted_debits long, posted_credits long, pending_debits long, pending_credits long")
    rows = [(b, i, b * 10 + i, (b + i) % 4, (b * i + 1) % 4, 150 * (i + 1), 0, [0, 8, 1, 0, 2][(b + i) % 5], i % 3, b) for b in range(6) for i in range(6)]
    columns = "batch_id long, idx int, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, timeout_ns long, now_ns long"
    submitted = spark.createDataFrame(rows, columns)
    expected = sorted(map(tuple, admission.admit_batches(submitted, accounts).collect()))
    seeds = accounts.selectExpr("-1L AS batch_id", "0 AS idx", "0L AS transfer_id", "account_id AS debit_account_id", "0L AS credit_account_id", "posted_credits AS amount", "ledger", "flags", "0L AS timeout_ns", "0L AS now_ns", "'account' AS kind")
    seeds.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seeds.schema).parquet(str(tmp_path / "in"))
    start = lambda: admit_stream(stream).writeStream.foreachBatch(append_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    start()
    for b in (0, 3):
        submitted.where(f"batch_id >= {b} AND batch_id < {b + 3}").withColumn("kind", F.lit("transfer")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start()
    got = spark.read.parquet(str(tmp_path / "out")).drop("epoch")
    assert sorted(map(tuple, got.collect())) == expected and any(r[4] for r in expected) and any(not r[4] for r in expected)


def test_fresh_keys(spark, tmp_path):
    rows = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:05:00"), ("m", "2024-01-01 00:01:00")], "idempotency_key string, t string").selectExpr("idempotency_key", "timestamp(t) AS event_time")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = fresh_keys(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.sql("SELECT idempotency_key FROM fresh").collect()) == ["k", "m"]


def test_state_is_small():
    from abacorn.operators.fold import Ledger

    assert pickle.loads(pickle.dumps(Ledger())) == Ledger()


def test_admission_goes_on_from_a_restored_journal(spark):
    """Batches folded at once, and folded in two runs with the journal of the first replayed between them."""
    names = "batch_id long, idx int, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, timeout_ns long, now_ns long"
    zero = F.lit(0).cast("long")
    accounts = spark.createDataFrame([(1, 1000), (2, 0), (3, 500)], "account_id long, posted_credits long").withColumns({"ledger": zero, "flags": zero, "currency": F.lit("USD"), "posted_debits": zero, "pending_debits": zero, "pending_credits": zero})
    first = [(1, 0, 10, 1, 2, 400, 0, 1, 100, 5), (1, 1, 11, 1, 2, 300, 0, 1, 0, 5), (2, 0, 11, 0, 0, 100, 0, 2, 0, 6), (2, 1, 12, 3, 2, 50, 0, 0, 0, 6)]
    then = [(3, 0, 13, 1, 2, 900, 0, 1, 0, 7), (3, 1, 11, 0, 0, 300, 0, 2, 0, 7), (3, 2, 11, 0, 0, 200, 0, 2, 0, 7), (4, 0, 12, 3, 2, 1, 0, 0, 0, 200), (4, 1, 10, 0, 0, 0, 0, 2, 0, 200), (4, 2, 14, 1, 2, 700, 0, 1, 0, 200)]
    outcomes = lambda df: sorted((r["batch_id"], r["idx"], r["error_code"]) for r in df.collect())
    whole = outcomes(admission.admit_batches(spark.createDataFrame(first + then, names), accounts))
    assert [e for *_, e in whole] == [None] * 4 + ["InsufficientFunds", "OverTransfer", None, "DuplicateTransferID", "PendingNotFound", None]
    rows = [(i + 1, r[2], r[3], r[4], r[5], r[6], r[7], r[9], r[8], r[0]) for i, r in enumerate(first)]
    journal_ = spark.createDataFrame(rows, "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, ts_ns long, timeout_ns long, batch_id long")
    after, state = admission.restore(accounts, journal_)
    assert state.clock_ns == 6 and {r["transfer_id"]: r["left"] for r in state.holds.collect()} == {10: 400, 11: 200}
    assert outcomes(admission.admit_batches(spark.createDataFrame(then, names), after, state)) == [x for x in whole if x[0] > 2]


def test_too_large_batches_and_no_rows(spark):
    accounts = Q.X.accounts(spark, DATA)
    rows = spark.range(8193).selectExpr("1L AS batch_id", "CAST(id AS INT) AS idx", "id AS transfer_id", "1L AS debit_account_id", "2L AS credit_account_id", "1L AS amount", "0L AS ledger", "0L AS flags", "0L AS timeout_ns", "1L AS now_ns")
    got = admission.admit_batches(rows.withColumn("ledger", F.col("transfer_id") % 3), accounts)
    assert {(r["error_code"], r["count"]) for r in got.groupBy("error_code").count().collect()} == {("BatchTooLarge", 8193)}
    assert admission.admit_batches(rows.limit(0), accounts).count() == 0


def test_key_memory_and_keyless_rows(spark, tmp_path):
    from abacorn.operators import idempotency

    minute = 60_000_000
    rows = [(1, "k", 0), (2, "k", 10 * minute), (3, "k", 20 * minute), (4, None, 0), (5, None, 1), (6, "j", 0), (7, "j", 15 * minute), (8, "j", 15 * minute + 1)]
    got = idempotency.within_ttl(spark.createDataFrame(rows, "event_id long, idempotency_key string, ts_us long"), 15 * minute).collect()
    assert {r["event_id"]: r["fresh"] for r in got} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True}
    spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "event_id long, idempotency_key string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, idempotency_key string").parquet(str(tmp_path / "in")).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000)))
    run = fresh_keys(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [1, 2] and len(got) == 3


def test_views_keep_submitted_accounts(spark):
    rows = [(1, 7, 1, 2, 50, 0, 1, 1, 0, 1), (2, 7, 9, 2, 20, 0, 2, 2, 0, 2), (3, 7, 0, 0, 0, 0, 2, 3, 0, 3)]
    j = spark.createDataFrame(rows, "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, ts_ns long, timeout_ns long, batch_id long")
    assert sorted((r["account_id"], r["lsn"]) for r in journal.history(j).collect()) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (9, 2)]
    assert [(r["lsn"], r["debit_account_id"]) for r in journal.latest(j.where("lsn < 3")).collect()] == [(2, 9)] and journal.latest(j).first()["debit_account_id"] == 1
    assert [r["transfer_id"] for r in journal.page(j, 2, None, 0).collect()] == [7, 7, 7] and journal.page(j, 2, 12345, 2).count() == 2


def test_windows_by_runs_are_windows_over_all(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows, accounts = [], [(a, 1000 * a) for a in range(4)]
    for lsn in range(1, 200):
        a, b = rng.sample(range(4), 2)
        rows.append((lsn, lsn, a, b, rng.randrange(1, 9), 0, 0, lsn, 0, 0))
    j = spark.createDataFrame(rows, "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, ts_ns long, timeout_ns long, batch_id long")
    opening = spark.createDataFrame(accounts, "account_id long, posted_credits long")
    want, at, place, balance = [], [], dict.fromkeys(range(4), 0), dict(accounts)
    for lsn, _, a, b, amount, *_ in rows:
        for account, delta in ((a, -amount), (b, amount)):
            balance[account] += delta
            place[account] += 1
            want.append((account, lsn, delta, balance[account]))
            at.append((account, lsn, place[account]))
    for run in (7, 1 << 20):
        monkeypatch.setattr(journal, "RUN", run)
        assert sorted(map(tuple, journal.running_balances(opening, j).collect())) == sorted(want)
        assert sorted((r["account_id"], r["lsn"], r["position"]) for r in journal.history(j).collect()) == sorted(at)


def test_batch_clock_by_runs(spark):
    now = [5, 5, 3, 90, 4, 4, 91, 91, 91, 2]
    batches = spark.createDataFrame([(i * 3, n) for i, n in enumerate(now)], "batch_id long, now_ns long")
    clock, want = None, []
    for n in now:
        clock = n if clock is None else max(n, clock + 1)
        want.append(clock)
    for width in (1, 4, 4096):
        assert [r["clock_ns"] for r in admission.batch_clock(batches, width).orderBy("batch_id").collect()] == want


def test_plain_records_beside_a_hold_of_the_same_id(spark):
    rows = [(1, 7, 1, 2, 10, 0, 1, 1, 0, 0), (2, 8, 1, 2, 5, 0, 8, 2, 0, 0), (3, 7, 0, 0, 4, 0, 2, 3, 0, 0), (4, 7, 0, 0, 0, 0, 2, 4, 0, 0), (5, 9, 1, 2, 3, 0, 1, 5, 2, 0), (6, 10, 2, 1, 1, 0, 0, 9, 0, 0)]
    j = spark.createDataFrame(rows, "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, ts_ns long, timeout_ns long, batch_id long")
    accounts = spark.createDataFrame([(1, 0, 100, 0, 0), (2, 0, 0, 0, 0), (3, 0, 7, 0, 0)], "account_id long, posted_debits long, posted_credits long, pending_debits long, pending_credits long")
    got = {r["account_id"]: tuple(r[c] for c in journal.STATE) for r in journal.balances(accounts, j).collect()}
    assert got == {1: (15, 101, 0, 0), 2: (1, 15, 0, 0), 3: (0, 7, 0, 0)}
    early = {r["account_id"]: tuple(r[c] for c in journal.STATE) for r in journal.balances(accounts, j, clock=6).collect()}
    assert early[1] == (15, 101, 3, 0) and early[2] == (1, 15, 0, 3)


def test_links_that_join_nothing(spark):
    """A linked row that stands alone, a row of a contested account, and an empty batch table."""
    accounts = spark.createDataFrame([(1, "USD", 0, 0, 0, 100, 0, 0), (2, "USD", 0, 0, 0, 0, 0, 0)], "account_id long, currency string, ledger long, flags long, posted_debits long, posted_credits long, pending_debits long, pending_credits long")
    schema = "batch_id long, idx int, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, timeout_ns long, now_ns long"
    for rows, want in (([(0, 0, 1, 1, 2, 5, 0, 8, 0, 1)], {1: "LinkedChainOpen"}), ([(0, 0, 1, 1, 2, 5, 0, 0, 0, 1), (1, 0, 2, 2, 1, 5, 0, 0, 0, 2)], {1: None, 2: None}), ([], {})):
        out = admission.admit_batches(spark.createDataFrame(rows, schema), accounts, buckets=2).collect()
        assert {r["transfer_id"]: r["error_code"] for r in out} == want


def test_rounds_of_components_leave_no_estimates(spark):
    """Sizes that a checkpoint remembers multiply in each join, and their digits from round to round, until the driver is full."""
    path = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(1).selectExpr("1000L as a", "1001L as b"))
    found = components(path)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(201)] + [(1000, 1000), (1001, 1000)]


def test_many_uses_of_one_key_take_linear_time(spark):
    """What is known of a use was appended to an array that was copied for each, so a key's uses took quadratic time."""
    items = spark.range(300_000).selectExpr("id as event_id", "'k' as idempotency_key", "id div 2 as ts_us")
    start = time.monotonic()
    fresh = [r[0] for r in idempotency.within_ttl(items, 999).where("fresh").orderBy("event_id").select("event_id").collect()]
    assert fresh == list(range(0, 300_000, 2000)) and time.monotonic() - start < 60


def test_keys_of_every_kind_and_uses_without_a_time(spark):
    rows = [(1, b"a", 10), (2, b"a", 5), (3, b"a", 15), (4, b"b", 15), (5, None, 15), (6, b"a", None), (7, b"a", 16), (8, b"a", 16)]
    items = spark.createDataFrame(rows, "event_id long, idempotency_key binary, ts_us long")
    got = {r["event_id"]: r["fresh"] for r in idempotency.within_ttl(items, 10).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_history_tells_equal_rows_without_a_hash_table(spark):
    """A hash table of a task's rows grew with its input; equal rows still have one place."""
    rows = [(1, 7, 1, 2, 10, 0, 1), (2, 7, 0, 0, 0, 0, 2), (3, 8, 2, 2, 5, 0, 0), (4, 9, 3, 1, 4, 0, 0)]
    j = spark.createDataFrame(rows, "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long").withColumns({"ts_ns": F.col("lsn"), "timeout_ns": F.lit(0).cast("long"), "batch_id": F.lit(0)})
    got = journal.history(j.union(j.where("lsn <> 2")).union(j.where("lsn = 3")))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 7, 1), (1, 2, 7, 2), (1, 4, 9, 3), (2, 1, 7, 1), (2, 2, 7, 2), (2, 3, 8, 3), (3, 4, 9, 1)]
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [account_id" in tree and not re.search(r"Aggregate \[account_id#\d+L, lsn#", tree)
