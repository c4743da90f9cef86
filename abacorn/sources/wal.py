"""Binary write-ahead logs: a Python data source for frames, and decoding and committed-prefix semantics as expressions.

A frame is [lsn 8][type 1][length 4][payload][crc32 4], big-endian, in segments wal-%06d.seg. Input files are never changed.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from abacorn import schema as S

HEADER, CHECKSUM, TRANSFER_BYTES, ACCOUNT_BYTES = 13, 4, 144, 128
SCHEMA = "segment long, offset long, lsn long, type int, payload binary, crc_ok boolean, torn boolean"
SEGMENT = re.compile(r"wal-(\d+)\.seg")


def segments(folder: str) -> list[tuple[int, str]]:
    """(id, path) of the segments of a folder, in order; folders, other names and ids below 1 don't count."""
    found = [(int(m[1]), os.path.join(folder, n)) for n in os.listdir(folder) if (m := SEGMENT.fullmatch(n)) and os.path.isfile(os.path.join(folder, n))]
    return sorted(x for x in found if x[0] > 0)


def frames(data: bytes, segment: int) -> Iterator[tuple]:
    """Rows of SCHEMA; a frame that passes the end is torn and ends the segment, and so are fewer bytes than a header (with lsn and type 0)."""
    at = 0
    while at + HEADER <= len(data):
        lsn, kind, length = struct.unpack_from(">QBI", data, at)
        end = at + HEADER + length
        if end + CHECKSUM > len(data):
            yield segment, at, lsn, kind, None, False, True
            return
        ok = zlib.crc32(data[at:end]) == struct.unpack_from(">I", data, end)[0]
        yield segment, at, lsn, kind, data[at + HEADER : end], ok, False
        at = end + CHECKSUM
    if at < len(data):
        yield segment, at, 0, 0, None, False, True


def encode(lsn: int, kind: int, payload: bytes) -> bytes:
    """One frame."""
    head = struct.pack(">QBI", lsn, kind, len(payload)) + payload
    return head + struct.pack(">I", zlib.crc32(head))


def encode_commit(lsn: int, count: int) -> bytes:
    return encode(lsn, S.COMMIT, struct.pack(">QI", lsn, count))


def encode_transfer(t: dict) -> bytes:
    """The fixed payload of a transfer; missing fields are zero."""
    b = lambda k, n: t.get(k, b"").rjust(n, b"\0")
    return b("transfer_id", 16) + b("debit_account_id", 16) + b("credit_account_id", 16) + t["amount"].to_bytes(16, "big") + b("idempotency_key", 32) + b("user_data", 16) + struct.pack(">qQIHxxIxxxx", t.get("ts_ns", 0), t.get("timeout_ns", 0), t.get("ledger", 0), t.get("code", 0), t.get("flags", 0))


def encode_account(a: dict) -> bytes:
    b = lambda k, n: a.get(k, b"").rjust(n, b"\0")
    money = b"".join(a.get(k, 0).to_bytes(16, "big") for k in ("posted_debits", "posted_credits", "pending_debits", "pending_credits"))
    return b("account_id", 16) + a.get("currency", "").encode()[:4].ljust(4, b"\0") + struct.pack(">IHxxI", a.get("ledger", 0), a.get("code", 0), a.get("flags", 0)) + b("user_data", 16) + money + bytes(16)


class _Segment(InputPartition):
    def __init__(self, number: int, path: str, above: int = 0, upto: int | None = None) -> None:
        super().__init__((number, path))
        self.number, self.path, self.above, self.upto = number, path, above, upto


class _Segments(InputPartition):
    """Segments in a row, for one task: a task for each costs more than small ones take to read."""

    def __init__(self, parts: list[_Segment]) -> None:
        super().__init__(tuple(p.value for p in parts))
        self.parts = parts


#: Bytes of segments that one task reads; a larger segment is a task of its own.
TASK_BYTES = 16 << 20


def _grouped(parts: list[_Segment]) -> list[_Segments]:
    """Segments in order, in runs of at most TASK_BYTES."""
    out, room = [], 0
    for part in parts:
        size = os.path.getsize(part.path)
        if not out or size > room:
            out.append([])
            room = TASK_BYTES
        out[-1].append(part)
        room -= size
    return [_Segments(x) for x in out]


def _read(part: _Segment | None) -> Iterator[tuple]:
    if part is None:  # what Spark hands over where there are no segments
        return
    with open(part.path, "rb") as file:
        for row in frames(file.read(), part.number):
            # a torn end has no LSN to go by, and a reader of the whole log must see it
            if row[2] > part.above and (part.upto is None or row[2] <= part.upto) or row[6] and part.upto is None:
                yield row


#: Frames of one Arrow batch.
FRAMES_AT_ONCE = 8192


def _batches(rows: Iterator[tuple]) -> Iterator:
    """Rows of SCHEMA as Arrow batches, which Spark takes without a look at each value."""
    import pyarrow as pa

    long, flag = pa.int64(), pa.bool_()
    schema = pa.schema([("segment", long), ("offset", long), ("lsn", long), ("type", pa.int32()), ("payload", pa.binary()), ("crc_ok", flag), ("torn", flag)])
    while part := list(islice(rows, FRAMES_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


#: How much of a segment's end is read for its last LSN.
TAIL = 65_536


def _last_lsn(path: str, commits: bool = False) -> int:
    """The LSN of the last sound frame (or commit) of a segment, from its last TAIL bytes; from all of it only if these hold none.

    A frame may start anywhere in the tail; the first place whose length fits and whose checksum holds starts a walk to the end.
    """
    wanted = lambda row: row[5] and (not commits or row[3] == S.COMMIT)
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        if size > TAIL:
            file.seek(size - TAIL)
            data = file.read()
            for at in range(len(data) - HEADER - CHECKSUM + 1):
                kind, length = struct.unpack_from(">BI", data, at + 8)
                end = at + HEADER + length
                if S.TRANSFER <= kind <= S.COMMIT and end + CHECKSUM <= len(data) and zlib.crc32(data[at:end]) == struct.unpack_from(">I", data, end)[0]:
                    found = max((row[2] for row in frames(data[at:], 0) if wanted(row)), default=0)
                    if found:
                        return found
                    break
            file.seek(0)
        return max((row[2] for row in frames(file.read(), 0) if wanted(row)), default=0)


class WalReader(DataSourceReader):
    """A partition for each run of segments; segments whose last LSN is not above the option from_lsn are left out."""

    def __init__(self, options: dict) -> None:
        self.folder, self.above = options["path"], int(options.get("from_lsn", 0))

    def partitions(self) -> list[_Segments]:
        return _grouped([_Segment(n, p, self.above) for n, p in segments(self.folder) if not self.above or _last_lsn(p) > self.above])

    def read(self, partition: _Segments | None) -> Iterator:
        return _batches(row for part in (partition.parts if partition else ()) for row in _read(part))


class WalStreamReader(DataSourceStreamReader):
    """The change feed: offsets are the LSNs of commits, so what is not committed stays hidden and batches are never cut.

    A segment is looked at again only when it has grown, and then at its tail; segments that end below a batch are not read for it.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.first = options["path"], int(options.get("from_lsn", 0))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {"lsn": self.first}

    def _commit(self, path: str) -> int:
        size = os.path.getsize(path)
        if self.known.get(path, (-1, 0))[0] != size:
            self.known[path] = size, _last_lsn(path, commits=True)
        return self.known[path][1]

    def latestOffset(self) -> dict:
        return {"lsn": max([self.first, *(self._commit(p) for _, p in segments(self.folder))])}

    def partitions(self, start: dict, end: dict) -> list[_Segment]:
        return [_Segment(n, p, start["lsn"], end["lsn"]) for n, p in segments(self.folder) if _last_lsn(p) > start["lsn"]]

    def read(self, partition: _Segment | None) -> Iterator[tuple]:
        return _read(partition)


class WalDataSource(DataSource):
    """spark.read.format("wal").option("path", folder); the folder must be on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalReader:
        return WalReader(self.options)

    def streamReader(self, schema) -> WalStreamReader:
        return WalStreamReader(self.options)


def committed(rows: DataFrame) -> DataFrame:
    """The records of fully committed batches, with commit_lsn: a batch is open across segments, and the first break ends the journal.

    Stray bytes at a segment's end and records of type 0 are breaks. A batch counts if as many sound records as its commit says stand between it and the commit before.
    """
    sound = F.col("crc_ok") & ~F.col("torn") & (F.col("type") != 0)
    broken = rows.where(~sound).agg(F.min(F.struct("segment", "offset")).alias("broken"))
    prefix = rows.crossJoin(F.broadcast(broken)).where(F.col("broken").isNull() | (F.struct("segment", "offset") < F.col("broken"))).drop("broken")  # one row
    # the commit of a record is the smallest one at or above it; LSNs rise, so a window over ranges of LSNs finds it, from the end: frames that grow by a row are linear
    commit = F.col("type") == S.COMMIT
    marked = prefix.withColumns({"bucket": F.floor(F.col("lsn") / 65536), "mark": F.when(commit, F.col("lsn"))})
    near = F.min("mark").over(W.partitionBy("bucket").orderBy(F.desc("lsn")).rowsBetween(W.unboundedPreceding, 0))
    firsts = marked.groupBy("bucket").agg(F.min("mark").alias("first_mark"))  # a row for each 65,536 LSNs
    carried = firsts.select("bucket", F.min("first_mark").over(W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    owned = marked.withColumn("commit_lsn", near).join(carried, "bucket").withColumn("commit_lsn", F.coalesce("commit_lsn", "carried")).where("commit_lsn is not null")
    batch = W.partitionBy("commit_lsn")
    counted = owned.withColumns({"n": F.count(F.when(~commit, 1)).over(batch), "expected": F.max(F.when(commit, word(F.col("payload"), 8, 4).cast("long"))).over(batch)})
    return counted.where(~commit & (F.col("n") == F.col("expected"))).select("commit_lsn", "segment", "offset", "lsn", "type", "payload")


def word(payload: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number at a byte position, as DECIMAL(20,0)."""
    return F.conv(F.hex(F.substring(payload, at + 1, size)), 16, 10).cast(S.U64)


def _money(payload: Column, at: int) -> Column:
    return F.try_add(F.try_multiply(word(payload, at, 8).cast(S.MONEY), F.lit(Decimal(1 << 64)).cast(S.MONEY)), word(payload, at + 8, 8).cast(S.MONEY)).cast(S.MONEY)


def _bytes(payload: Column, at: int, size: int) -> Column:
    return F.substring(payload, at + 1, size)


def transfers(rows: DataFrame) -> DataFrame:
    """Decoded transfer records."""
    p = F.col("payload")
    key = _bytes(p, 64, 32)
    sound = rows.where((F.col("type") == S.TRANSFER) & (F.octet_length(p) == TRANSFER_BYTES))
    return sound.select("lsn", _bytes(p, 0, 16).alias("transfer_id"), _bytes(p, 16, 16).alias("debit_account_id"), _bytes(p, 32, 16).alias("credit_account_id"), _money(p, 48).alias("amount"), F.when(F.hex(key) != "0" * 64, key).alias("idempotency_key"), _bytes(p, 96, 16).alias("user_data"), word(p, 112, 8).cast("long").alias("ts_ns"), word(p, 120, 8).alias("timeout_ns"), word(p, 128, 4).cast("long").alias("ledger"), word(p, 132, 2).cast("int").alias("code"), word(p, 136, 4).cast("long").alias("flags"))


def accounts(rows: DataFrame) -> DataFrame:
    """Decoded account records."""
    p = F.col("payload")
    sound = rows.where((F.col("type") == S.ACCOUNT) & (F.octet_length(p) == ACCOUNT_BYTES))
    money = {c: _money(p, 48 + 16 * i).alias(c) for i, c in enumerate(("posted_debits", "posted_credits", "pending_debits", "pending_credits"))}
    currency = F.regexp_replace(_bytes(p, 16, 4).cast("string"), "\\x00+$", "")
    return sound.select("lsn", _bytes(p, 0, 16).alias("account_id"), currency.alias("currency"), word(p, 20, 4).cast("long").alias("ledger"), word(p, 24, 2).cast("int").alias("code"), word(p, 28, 4).cast("long").alias("flags"), _bytes(p, 32, 16).alias("user_data"), *money.values())


def number(value: Column, size: int) -> Column:
    """An unsigned number below 2**63 as size big-endian bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def transfer_payload(t: dict[str, Column]) -> Column:
    """The fixed payload of a transfer from columns of numbers (ids, amount, ts_ns, timeout_ns, ledger, code, flags) and 32 bytes of key; missing fields are zero."""
    n = lambda c, size: number(t.get(c, F.lit(0)), size)
    gap = lambda size: F.unhex(F.lit("00" * size))
    ids = [n(c, 16) for c in ("transfer_id", "debit_account_id", "credit_account_id", "amount")]
    key = F.coalesce(t.get("idempotency_key", F.lit(None).cast("binary")), gap(32))
    return F.concat(*ids, key, n("user_data", 16), n("ts_ns", 8), n("timeout_ns", 8), n("ledger", 4), n("code", 2), gap(2), n("flags", 4), gap(4))


def checkpoint_payload(lsn: Column) -> Column:
    return number(lsn, 8)


def framed(entries: DataFrame, after_lsn: int = 0) -> DataFrame:
    """(batch_id, lsn, type, frame) of entries (batch_id, idx, type, payload): LSNs rise from after_lsn by batch and idx, and a commit ends each batch.

    A window sees a batch, or one row for each run of 4096 batches.
    """
    sizes = entries.groupBy("batch_id").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("batch_id") / 4096))
    runs = sizes.groupBy("run").agg(F.sum(F.col("n") + 1).alias("here"))
    runs = runs.select("run", F.coalesce(F.sum("here").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    inside = W.partitionBy("run").orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum(F.col("n") + 1).over(inside), F.lit(0))).join(runs, "run")
    starts = starts.select("batch_id", "n", (F.lit(after_lsn) + F.col("carried") + F.col("inside")).alias("before"))
    nth = F.row_number().over(W.partitionBy("batch_id").orderBy("idx"))
    data = entries.join(starts, "batch_id").select("batch_id", (F.col("before") + nth).alias("lsn"), "type", "payload")
    end = F.col("before") + F.col("n") + 1
    commits = starts.select("batch_id", end.alias("lsn"), F.lit(S.COMMIT).alias("type"), F.concat(number(end, 8), number(F.col("n"), 4)).alias("payload"))
    head = F.concat(number(F.col("lsn"), 8), number(F.col("type"), 1), number(F.octet_length("payload"), 4), F.col("payload"))
    both = data.unionByName(commits).withColumn("head", head)
    return both.select("batch_id", "lsn", "type", F.concat("head", number(F.crc32("head"), 4)).alias("frame"))


def append(entries: DataFrame, folder: str, at_least: int = 0, per_segment: int = 64) -> DataFrame:
    """Append entries (batch_id, idx, type, payload) to a log in new segments of per_segment batch ids each; (segment, first_lsn, last_lsn, bytes) of what was written.

    LSNs go on above the log's last one and above at_least, the LSN of a snapshot that is ahead of the log. A segment is written under another name
    and then renamed, so a task that runs again replaces its own. The result is computed once, when the call returns.
    """
    old = segments(folder)
    after = max([at_least, *(_last_lsn(p) for _, p in old)])
    first = max([0, *(n for n, _ in old)]) + 1
    part = F.floor(F.col("batch_id") / per_segment).alias("part")
    rows = framed(entries, after).select("*", part)
    numbered = entries.select(part).distinct().select("part", (F.row_number().over(W.orderBy("part")) + F.lit(first - 1)).alias("segment"))  # one row a segment

    def write(frame):
        import pandas as pd

        frame = frame.sort_values("lsn")
        number_, path = int(frame["segment"].iloc[0]), os.path.join(folder, f"wal-{int(frame['segment'].iloc[0]):06d}.seg")
        data = b"".join(frame["frame"])
        with open(f"{path}.{os.getpid()}.tmp", "wb") as file:
            file.write(data)
        os.replace(f"{path}.{os.getpid()}.tmp", path)
        return pd.DataFrame([(number_, int(frame["lsn"].min()), int(frame["lsn"].max()), len(data))], columns=["segment", "first_lsn", "last_lsn", "bytes"])

    done = rows.join(numbered, "part").select("segment", "lsn", "frame").groupBy("segment").applyInPandas(write, "segment long, first_lsn long, last_lsn long, bytes long")
    return entries.sparkSession.createDataFrame(done.collect(), done.schema)  # a row a segment


def truncate(folder: str, lsn: int) -> list[int]:
    """Delete the segments that end below lsn, but never the last one; their ids."""
    gone = [(n, p) for n, p in segments(folder)[:-1] if _last_lsn(p) < lsn]
    for _, path in gone:
        os.remove(path)
    return [n for n, _ in gone]


def reset(folder: str) -> None:
    """Delete every segment."""
    for _, path in segments(folder):
        os.remove(path)


def flip_bit(path: str, at: int, bit: int = 0) -> None:
    """Fault injection for tests: one bit of a file is turned over."""
    with open(path, "r+b") as file:
        file.seek(at)
        value = file.read(1)[0]
        file.seek(at)
        file.write(bytes([value ^ (1 << bit)]))


def overwrite(path: str, at: int, data: bytes) -> None:
    """Fault injection for tests: bytes of a file are replaced."""
    with open(path, "r+b") as file:
        file.seek(at)
        file.write(data)


def shorten(path: str, by: int) -> None:
    """Fault injection for tests: bytes are cut off a file's end."""
    os.truncate(path, os.path.getsize(path) - by)
