"""Binary logs and snapshots: round trips, every torn byte, planted faults."""

import os

from pyspark.sql import functions as F

from abacorn.sources import snapshot, wal


def key(v: int) -> bytes:
    return v.to_bytes(16, "big")


def log() -> tuple[bytes, list[tuple[int, list[int]]]]:
    """Batches [account, account] [10, 20, 30] [40, 50] [60], and for each the byte where its commit ends and its LSNs."""
    out, ends, lsn = b"", [], 0
    batches = [[("a", 1), ("a", 2)], [("t", 10), ("t", 20), ("t", 30)], [("t", 40), ("t", 50)], [("t", 60)]]
    for batch in batches:
        lsns = []
        for kind, v in batch:
            lsn += 1
            lsns.append(lsn)
            payload = wal.encode_account({"account_id": key(v), "currency": "USD", "posted_credits": 1000 if v == 1 else 0}) if kind == "a" else wal.encode_transfer({"transfer_id": key(v), "debit_account_id": key(1), "credit_account_id": key(2), "amount": v, "ts_ns": 7, "flags": 1})
            out += wal.encode(lsn, 2 if kind == "a" else 1, payload)
        lsn += 1
        out += wal.encode_commit(lsn, len(batch))
        ends.append((len(out), lsns))
    return out, ends


def put(folder, *segments: bytes) -> str:
    for i, data in enumerate(segments, 1):
        with open(os.path.join(folder, f"wal-{i:06d}.seg"), "wb") as file:
            file.write(data)
    return str(folder)


def test_frame_sizes():
    assert len(wal.encode(1, 2, wal.encode_account({}))) == 145 and len(wal.encode(1, 1, wal.encode_transfer({"amount": 0}))) == 161 and len(wal.encode_commit(1, 1)) == 29


def test_round_trip(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    data, _ = log()
    (tmp_path / "notes.txt").write_text("x")
    path = put(tmp_path, data)
    rows = wal.committed(spark.read.format("wal").option("path", path).load())
    got = wal.transfers(rows).orderBy("lsn").collect()
    assert [int(r["amount"]) for r in got] == [10, 20, 30, 40, 50, 60] and got[0]["transfer_id"] == key(10) and got[0]["ts_ns"] == 7 and got[0]["flags"] == 1 and got[0]["idempotency_key"] is None
    accounts = wal.accounts(rows).orderBy("lsn").collect()
    assert [(r["currency"], int(r["posted_credits"])) for r in accounts] == [("USD", 1000), ("USD", 0)]
    late = spark.read.format("wal").option("path", path).option("from_lsn", 8).load()
    assert late.agg(F.min("lsn")).first()[0] == 9


def test_every_torn_byte():
    """For every cut, the committed prefix by an independent count is exactly the batches whose commit precedes it."""
    data, ends = log()
    for cut in range(len(data) + 1):
        rows, open_, done = list(wal.frames(data[:cut], 1)), [], []
        for _, _, lsn, kind, payload, ok, torn in rows:
            if torn or not ok:
                break
            if kind == 4:
                if int.from_bytes(payload[8:12], "big") == len(open_):
                    done += open_
                open_ = []
            else:
                open_.append(lsn)
        assert done == [x for end, lsns in ends if end <= cut for x in lsns]


def test_committed_prefix(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    data, ends = log()
    for n, cut in enumerate((len(data), ends[2][0] + 5, ends[2][0] - 1, ends[1][0], 40)):
        folder = tmp_path / str(n)
        folder.mkdir()
        cut_at = 161 * 2 + 145 * 2 + 29  # a rotation within the second batch
        put(folder, data[:cut][:cut_at], data[:cut][cut_at:])
        got = wal.committed(spark.read.format("wal").option("path", str(folder)).load())
        assert sorted(r["lsn"] for r in got.select("lsn").collect()) == [x for end, lsns in ends if end <= cut for x in lsns]


def test_corrupt_byte():
    data, _ = log()
    rows = list(wal.frames(data[:40] + bytes([data[40] ^ 255]) + data[41:], 1))
    assert [r[5] for r in rows].count(False) == 1 and not any(r[6] for r in rows)


def test_stream(spark, tmp_path):
    spark.dataSource.register(wal.WalDataSource)
    data, ends = log()
    folder = tmp_path / "feed"
    folder.mkdir()
    put(folder, data[: ends[1][0] + 50])  # an open batch stays hidden
    feed = spark.readStream.format("wal").option("path", str(folder)).load()
    run = lambda: feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    run()
    first = sorted(r["lsn"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert first == list(range(1, 8))
    put(folder, data)
    run()
    assert sorted(r["lsn"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, 13))


def test_snapshots(spark, tmp_path):
    spark.dataSource.register(snapshot.SnapshotDataSource)
    account, hold = wal.encode_account({"account_id": key(1), "currency": "EUR", "posted_credits": 5}), wal.encode_transfer({"transfer_id": key(9), "amount": 3})
    (tmp_path / "snapshot-10.snap").write_bytes(snapshot.encode(10, [account], [hold]))
    broken = bytearray(snapshot.encode(20, [account], []))
    broken[30] ^= 1
    (tmp_path / "snapshot-20.snap").write_bytes(bytes(broken))
    (tmp_path / "snapshot-30.snap").write_bytes(snapshot.encode(31, [], []))
    rows = spark.read.format("ledger_snapshot").option("path", str(tmp_path)).load()
    assert [r["snapshot_lsn"] for r in rows.collect()] == [10, 10]
    assert wal.accounts(rows).first()["currency"] == "EUR" and int(wal.transfers(rows).first()["amount"]) == 3
    where = snapshot.write(wal.accounts(rows), wal.transfers(rows), str(tmp_path / "tables"), 10, 99)
    accounts, holds, manifest = snapshot.read(spark, where)
    assert (accounts.count(), holds.count(), manifest["clock_ns"]) == (1, 1, 99)
