"""Shared pieces: materialising a result, bounded broadcasts, salted joins and batch slicing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a frame of fixed-width columns, at 16 a value, up to which it may be broadcast; beyond it every operator shuffles instead.
BROADCAST_BYTES = 32 << 20
#: A join key is hot with over HOT_ROWS rows and over 1 / HOT_KEYS of all, so that there are fewer than HOT_KEYS of them; each is dealt to SALTS tasks.
HOT_ROWS, HOT_KEYS, SALTS = 1000, 2000, 64

#: Bytes of text a Python worker works on at once. Spark itself bounds an Arrow batch by rows and, at 64 MB unless it is told otherwise, by bytes.
CHARS_AT_ONCE = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse's; a temporary one only if all run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        folder = _own_folder(spark.sparkContext.master, spark.conf.get("spark.sql.warehouse.dir"))
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_folder(master: str, warehouse: str) -> str:
    """A folder for a session without spark.checkpoint.dir. On a cluster a file: warehouse may be each machine's own, so it is refused."""
    if re.fullmatch(r"local(\[.*\])?", master):
        return "file://" + tempfile.mkdtemp(prefix="abacorn-")
    if warehouse.startswith("file:") or ":/" not in warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_abacorn"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage ends there, and a lost executor loses nothing of it.

    release() deletes it; what isn't released goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/abacorn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    atexit.register(_remove, spark, path)
    out._written = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete what materialise() wrote for frames that nothing reads any more."""
    for df in frames:
        if df is not None and hasattr(df, "_written"):
            _remove(df.sparkSession, df._written)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised frame of fixed-width columns: hinted for broadcast if its counted rows make few enough bytes, else as it is."""
    return F.broadcast(df) if df.count() * 16 * len(df.columns) <= bytes_ else df


def hot_keys(df: DataFrame, key: str) -> list:
    """The hot values of a key of a materialised frame: fewer than HOT_KEYS, whatever its size."""
    bound = max(HOT_ROWS, df.count() // HOT_KEYS)
    return [r[0] for r in df.groupBy(key).count().where((F.col("count") > bound) & F.col(key).isNotNull()).select(key).collect()]


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """left.join(right, keys, how) for a materialised left of which few values of the first key may hold most rows, and a right of few rows for each key.

    Rows of hot values are dealt by a hash of the whole row, and right's rows for those values are sent to each of their SALTS tasks.
    """
    hot = hot_keys(left, keys[0]) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    mine = F.col(keys[0]).isin(hot)
    salted = left.withColumn("_salt", F.when(mine, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    spread = right.withColumn("_salt", F.explode(F.when(mine, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")


def held_out(column: str = "doc_id"):
    """True for the third of the documents that no model may learn from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about so many bytes of text; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
        part = (np.cumsum(sizes) - sizes) // chars
        edges = (np.flatnonzero(np.diff(part)) + 1).tolist()
        for low, high in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(low, high - low)
    _give_back()


def _give_back() -> None:
    """At a task's end, return what its worker's allocators hold: workers live on, beside the next task's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of columns, lists or arrays, in the order of schema."""
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, ..." with the types that the operators return."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in ddl.split(", ")])


def keep_rows(docs: DataFrame, keep: Callable[[list], list]) -> DataFrame:
    """The rows of docs, all columns as they are, for whose texts keep says True. keep: from texts to booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(keep(part.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_codes(words: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words in order of first appearance, and the distinct words."""
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes.astype(np.int64), distinct


def text_hashes(words: np.ndarray) -> np.ndarray:
    """Stable 64-bit hashes of distinct words."""
    return pd.util.hash_array(words, categorize=False).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
