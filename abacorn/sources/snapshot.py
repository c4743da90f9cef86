"""Snapshots: a Python data source for the binary form, and Parquet snapshots with a manifest."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from abacorn import schema as S
from abacorn.operators.admission import restore
from abacorn.sources.wal import ACCOUNT_BYTES, TRANSFER_BYTES

#: The header and the file names of binary snapshots.
MAGIC, NAME = b"LEDGER03", re.compile(r".*-(\d+)\.snap")
SCHEMA = "snapshot_lsn long, lsn long, type int, payload binary"


def decode(data: bytes, magic: bytes = MAGIC) -> tuple[int, list[bytes], list[bytes]] | None:
    """(lsn, account payloads, open hold payloads), or None unless magic, counts and checksum hold."""
    if len(data) < 36 or data[:8] != magic or zlib.crc32(data[:-4]) != struct.unpack(">I", data[-4:])[0]:
        return None
    lsn, n = struct.unpack_from(">QQ", data, 8)
    at = 24 + n * ACCOUNT_BYTES
    if at + 12 > len(data):
        return None
    (m,) = struct.unpack_from(">Q", data, at)
    if at + 8 + m * TRANSFER_BYTES + 4 != len(data):
        return None
    cut = lambda start, count, size: [data[start + i * size : start + (i + 1) * size] for i in range(count)]
    return lsn, cut(24, n, ACCOUNT_BYTES), cut(at + 8, m, TRANSFER_BYTES)


def encode(lsn: int, accounts: list[bytes], holds: list[bytes], magic: bytes = MAGIC) -> bytes:
    body = magic + struct.pack(">QQ", lsn, len(accounts)) + b"".join(accounts) + struct.pack(">Q", len(holds)) + b"".join(holds)
    return body + struct.pack(">I", zlib.crc32(body))


def newest(folder: str) -> tuple[int, str] | None:
    """(lsn, path) of the newest sound snapshot whose name says its LSN."""
    names = sorted(((int(m[1]), n) for n in os.listdir(folder) if (m := NAME.fullmatch(n))), reverse=True)
    for lsn, name in names:
        with open(os.path.join(folder, name), "rb") as file:
            held = decode(file.read())
        if held and held[0] == lsn:
            return lsn, os.path.join(folder, name)
    return None


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = newest(self.folder)
        return [InputPartition(found[1])] if found else []

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands over where there is no snapshot
            return
        with open(partition.value, "rb") as file:
            lsn, accounts, holds = decode(file.read())
        yield from ((lsn, lsn, S.ACCOUNT, p) for p in accounts)
        yield from ((lsn, lsn, S.TRANSFER, p) for p in holds)


class SnapshotDataSource(DataSource):
    """spark.read.format("ledger_snapshot").option("path", folder): account and hold payloads of the newest sound snapshot."""

    @classmethod
    def name(cls) -> str:
        return "ledger_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def write(accounts: DataFrame, holds: DataFrame, folder: str, lsn: int, clock_ns: int) -> str:
    """A Parquet snapshot: two tables, then the manifest, which makes it count; what a crash left behind without one is written over."""
    spark, path = accounts.sparkSession, f"{folder}/snapshot-{lsn:020d}"
    accounts.write.mode("overwrite").parquet(f"{path}/accounts")
    holds.write.mode("overwrite").parquet(f"{path}/holds")
    spark.createDataFrame([(json.dumps({"lsn": lsn, "clock_ns": clock_ns}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return spark.read.parquet(f"{path}/accounts"), spark.read.parquet(f"{path}/holds"), manifest


def retained(manifests: DataFrame, keep: int = S.SNAPSHOTS_KEPT) -> DataFrame:
    """manifests (lsn, ...) with keeps: whether the snapshot is among the newest."""
    return manifests.withColumn("keeps", F.row_number().over(W.orderBy(F.desc("lsn"))) <= keep)


def truncatable(segments: DataFrame, lsn: int) -> DataFrame:
    """segments (segment, max_lsn) that retention may drop: all of them below lsn, but never the active, last one."""
    last = segments.agg(F.max("segment").alias("active"))
    return segments.crossJoin(F.broadcast(last)).where((F.col("max_lsn") < lsn) & (F.col("segment") != F.col("active"))).drop("active")  # one row


def trigger(accounts: DataFrame, journal: DataFrame, folder: str, keep: int = S.SNAPSHOTS_KEPT) -> int:
    """Snapshot the state after the journal, then drop all but the newest; the snapshot's LSN, 0 if there is nothing to hold. The log may then be truncated below it."""
    lsn = journal.agg(F.max("lsn")).first()[0]
    if not lsn:
        return 0
    after, state = restore(accounts, journal)
    write(after, state.holds, folder, lsn, state.clock_ns)
    names, fs = listed(after.sparkSession, folder)
    for name in names[:-keep]:
        fs.delete(fs.makeQualified(after.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")), True)
    return lsn


def listed(spark: SparkSession, folder: str) -> tuple[list[str], object]:
    """The Parquet snapshots of a folder that have a manifest, oldest first, and the folder's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted(n for n in found if n.startswith("snapshot-") and fs.exists(path(f"{folder}/{n}/manifest/_SUCCESS"))), fs
