"""Breaks of a log and repeated snapshot writes."""

from pyspark.sql import functions as F

from abacorn import schema as S
from abacorn.sources import snapshot, wal


def log(folder, *segments):
    for i, data in enumerate(segments, 1):
        (folder / f"wal-{i:06d}.seg").write_bytes(data)
    return str(folder)


def test_stray_bytes_and_type_0_end_the_journal(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    one = wal.encode(1, S.CHECKPOINT, b"x") + wal.encode_commit(2, 1)
    two = wal.encode(3, S.CHECKPOINT, b"y") + wal.encode_commit(4, 1)
    for n, (name, first, want) in enumerate([("sound", one, [1, 3]), ("stray", one + b"\0" * 12, [1]), ("one byte", one + b"z", [1]), ("type 0", one + wal.encode(9, 0, b""), [1]), ("torn", one[:-3], [])]):
        folder = tmp_path / str(n)
        folder.mkdir()
        rows = spark.read.format("wal").option("path", log(folder, first, two)).load()
        assert sorted(r["lsn"] for r in wal.committed(rows).collect()) == want, name


def test_a_snapshot_can_be_written_again(spark, tmp_path):
    accounts, holds = spark.range(3).withColumnRenamed("id", "account_id"), spark.range(1)
    (tmp_path / "snapshot-00000000000000000007" / "accounts").mkdir(parents=True)
    for _ in range(2):
        path = snapshot.write(accounts, holds, str(tmp_path), 7, 99)
    read, _, manifest = snapshot.read(spark, path)
    assert read.agg(F.count("*")).first()[0] == 3 and manifest == {"lsn": 7, "clock_ns": 99}


def test_append_truncate_reset(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    folder = str(tmp_path)
    entries = spark.range(40).selectExpr("id div 4 as batch_id", "id % 4 as idx", "3 as type", "cast(id as string) as text").select("batch_id", "idx", "type", F.col("text").cast("binary").alias("payload"))
    wal.append(entries.where("batch_id < 6"), folder, per_segment=2)
    assert [n for n, _ in wal.segments(folder)] == [1, 2, 3] and [wal._last_lsn(p) for _, p in wal.segments(folder)] == [10, 20, 30]
    done = wal.append(entries.where("batch_id >= 6"), folder, at_least=100, per_segment=2).orderBy("segment").collect()
    assert [(r["segment"], r["first_lsn"], r["last_lsn"]) for r in done] == [(4, 101, 110), (5, 111, 120)]
    rows = wal.committed(spark.read.format("wal").option("path", folder).load()).orderBy("lsn").collect()
    assert [bytes(r["payload"]).decode() for r in rows] == [str(i) for i in range(40)]
    assert wal.append(entries.where("false"), folder).count() == 0 and len(wal.segments(folder)) == 5
    assert wal.truncate(folder, 20) == [1] and wal.truncate(folder, 10**9) == [2, 3, 4]
    wal.reset(folder)
    assert wal.segments(folder) == []


def test_last_lsn_from_the_tail(tmp_path):
    path = tmp_path / "wal-000001.seg"
    data = b"".join(wal.encode(i, S.CHECKPOINT, b"p" * 150) for i in range(1, 1001)) + wal.encode_commit(1001, 1000)
    path.write_bytes(data)
    assert wal._last_lsn(str(path)) == 1001 == wal._last_lsn(str(path), commits=True)
    wal.shorten(str(path), 3)
    assert wal._last_lsn(str(path)) == 1000 and wal._last_lsn(str(path), commits=True) == 0
    wal.flip_bit(str(path), len(data) - 29 - 100)  # the last whole frame
    assert wal._last_lsn(str(path)) == 999
    wal.overwrite(str(path), 0, b"\0" * 20)
    assert wal._last_lsn(str(path)) == 999
    path.write_bytes(b"")
    assert wal._last_lsn(str(path)) == 0


def test_payload_as_an_expression_is_the_encoders(spark):
    row = spark.range(1).select(wal.transfer_payload({c: F.lit(v) for c, v in (("transfer_id", 7), ("debit_account_id", 8), ("credit_account_id", 9), ("amount", 10**15), ("ts_ns", 11), ("timeout_ns", 12), ("ledger", 13), ("code", 14), ("flags", 15))}).alias("p")).first()
    ids = {c: v.to_bytes(16, "big") for c, v in (("transfer_id", 7), ("debit_account_id", 8), ("credit_account_id", 9))}
    assert bytes(row["p"]) == wal.encode_transfer(ids | {"amount": 10**15, "ts_ns": 11, "timeout_ns": 12, "ledger": 13, "code": 14, "flags": 15})


def test_snapshots_are_triggered_and_three_stay(spark, tmp_path):
    accounts = spark.createDataFrame([(1, 0, 0, 0, 100, 0, 0), (2, 0, 0, 0, 0, 0, 0)], "account_id long, ledger long, flags long, posted_debits long, posted_credits long, pending_debits long, pending_credits long")
    journal = spark.createDataFrame([(n, n, 1, 2, 10, 0, n % 2, n, 0, n) for n in range(1, 6)], "lsn long, transfer_id long, debit_account_id long, credit_account_id long, amount long, ledger long, flags long, ts_ns long, timeout_ns long, batch_id long")
    folder = f"file:{tmp_path}"
    assert snapshot.trigger(accounts, journal.where("false"), folder) == 0
    for n in range(1, 6):
        assert snapshot.trigger(accounts, journal.where(F.col("lsn") <= n), folder) == n
    names, _ = snapshot.listed(spark, folder)
    assert [int(x.rsplit("-", 1)[1]) for x in names] == [3, 4, 5]
    state, holds, manifest = snapshot.read(spark, f"{folder}/{names[-1]}")
    assert {r["account_id"]: (r["posted_debits"], r["posted_credits"], r["pending_debits"]) for r in state.collect()} == {1: (20, 100, 30), 2: (0, 20, 0)}
    assert sorted(r["transfer_id"] for r in holds.collect()) == [1, 3, 5] and manifest["clock_ns"] == 5


def test_a_folder_without_segments_or_snapshots_is_empty(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    spark.dataSource.register(snapshot.SnapshotDataSource)
    for name in ("wal", "ledger_snapshot"):
        assert spark.read.format(name).option("path", str(tmp_path)).load().count() == 0


def test_commits_across_ranges_of_lsns_by_windows_that_grow(spark, tmp_path):
    """A frame that ends at its partition's end is summed anew for each row, so 65,536 LSNs took two thousand million steps."""
    spark.dataSource.register(wal.WalDataSource)
    folder = str(tmp_path)
    entries = spark.range(30).selectExpr("id div 10 as batch_id", "id as idx", "3 as type", "cast(cast(id as string) as binary) as payload")
    wal.append(entries, folder, at_least=65_530, per_segment=1)  # the first batch begins below LSN 65,536 and ends above
    rows = wal.committed(spark.read.format("wal").option("path", folder).load())
    assert "unboundedfollowing" not in rows._jdf.queryExecution().toString().lower()
    assert sorted((r["lsn"], r["commit_lsn"]) for r in rows.collect()) == [(65_531 + 11 * b + i, 65_541 + 11 * b) for b in range(3) for i in range(10)]
