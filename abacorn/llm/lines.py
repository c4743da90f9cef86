"""Line dedup by distinct-site spread.

Every line with a letter or a digit is hashed. A HyperLogLog sketch of the sites (sources) that show it is kept for each line hash and
merges by aggregation, before the shuffle and after it. Lines whose estimate is far above SITES are settled by it; all others that are
seen SITES times get an exact distinct count of their sites: a sketch has few registers, so sites that share them can hide a line. Lines of SITES sites or more are boilerplate: they stay at their first place (in the document of the
smallest doc_id, the first of equals there) and are removed everywhere else.

The sketches' sizes are fixed and merge per task, so a line that every document holds costs a task one row. The set of boilerplate lines is
counted; up to BROADCAST_BYTES of them, at ENTRY_BYTES each, are sent to all tasks and texts stay where they are, and beyond it line places are joined by
shuffle. Defined cases: null texts stay null and empty ones empty; lines without a letter or digit (blank ones, rules, lone brackets) always stay; a null source is no
site; where doc_id is null no line counts as the first. Repeated rows are cleaned alike. Lines are compared without
spaces, tabs and carriage returns at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import BROADCAST_BYTES, broadcast_if_small, materialise, slices

SITES = 5
#: What a line must hold to count, for Java and for regex alike.
COUNTS = r"[\p{L}\p{N}]"
COUNTED = regex.compile(COUNTS)
#: Relative standard error of a sketch; estimates up to NEAR above SITES are counted exactly (over three standard errors).
ERROR, NEAR = 0.1, 0.35
#: Bytes of a line hash and its first place in a Python dictionary.
ENTRY_BYTES = 160
ENDS = " \t\r"


def line_sites(docs: DataFrame) -> DataFrame:
    """A row for each line that counts: hash, site, doc_id; docs: doc_id, text, source."""
    lines = docs.where("text is not null").select("doc_id", F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("raw"))
    line = F.btrim("raw", F.lit(ENDS))
    return lines.where(line.rlike(COUNTS)).select(F.xxhash64(line).alias("hash"), "site", "doc_id")


def boilerplate(docs: DataFrame) -> DataFrame:
    """(hash, first): the lines on SITES sites or more, and the smallest doc_id that has them."""
    lines = line_sites(docs)
    # a line on as many sites is on as many lines: the rest needs no second look
    rated = lines.groupBy("hash").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    rated = materialise(rated.where(F.col("n") >= SITES), "rated")
    near = F.col("sites") <= SITES * (1 + NEAR)
    asked = rated.where(near).select("hash")
    exact = lines.join(broadcast_if_small(asked), "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("exact"))
    kept = exact.where(F.col("exact") >= SITES).select("hash")
    return materialise(rated.where(~near).select("hash", "first").union(rated.join(kept, "hash").select("hash", "first")), "boilerplate")


def clean(text: str, doc_id: int | None, first: dict[int, int | None]) -> tuple[str, int]:
    """text without the boilerplate lines whose place is elsewhere, and their number."""
    import xxhash

    out, seen, lines = [], set(), text.split("\n")
    for line in lines:
        bare = line.strip(ENDS)
        if COUNTED.search(bare):
            value = xxhash.xxh64_intdigest(bare.encode(), 42)
            value -= (value >> 63) << 64
            if value in first:
                if doc_id is None or first[value] != doc_id or value in seen:
                    continue
                seen.add(value)
        out.append(line)
    return ("\n".join(out), len(lines) - len(out)) if len(out) < len(lines) else (text, 0)


def dedup_lines(docs: DataFrame, counter: str = "n_lines_removed") -> DataFrame:
    """docs (doc_id, text, source, whatever else), with text cleaned and, where there is one, n_chars counted again; and the lines removed.

    A column of docs with counter's name gives way to it.
    """
    docs = docs.drop(counter)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    found = boilerplate(narrow)
    out = _in_place(docs, found, counter) if found.count() * ENTRY_BYTES <= BROADCAST_BYTES else _by_shuffle(docs, found, counter)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _in_place(docs: DataFrame, found: DataFrame, counter: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast({r["hash"]: r["first"] for r in found.collect()})
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = pc.cast(part.column("doc_id"), pa.int64()).to_pylist()
            both = [(None, 0) if t is None else clean(t, i, sent.value) for i, t in zip(ids, part.column("text").to_pylist())]
            columns = list(part.columns)
            columns[at] = pa.array([t for t, _ in both], part.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in both], pa.int32())], names=[*names, counter])

    return docs.mapInArrow(run, docs.withColumn(counter, F.lit(0).cast("int")).schema)


def _by_shuffle(docs: DataFrame, found: DataFrame, counter: str) -> DataFrame:
    """The same by a join of line places: for more boilerplate than a task should hold."""
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    places = rows.where("text is not null").select("__row", F.col("doc_id").cast("long").alias("__id"), F.posexplode(F.split("text", "\n")).alias("__at", "__raw"))
    line = F.btrim("__raw", F.lit(ENDS))
    hit = places.where(line.rlike(COUNTS)).select("__row", "__id", "__at", F.xxhash64(line).alias("hash")).join(found, "hash")
    home = hit.where(F.col("__id") == F.col("first")).groupBy("__row", "hash").agg(F.min("__at").alias("__at"))
    gone = hit.select("__row", "hash", "__at").join(home, ["__row", "hash", "__at"], "left_anti").groupBy("__row").agg(F.collect_set("__at").alias("__gone"))
    joined = rows.join(gone, "__row", "left")
    rest = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    joined = joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")))
    return joined.withColumn(counter, F.coalesce(F.size("__gone"), F.lit(0))).select(*docs.columns, counter)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The columns of docs, cleaned; a document that had words and lost every one of them is all copies of lines kept elsewhere, and goes."""
    words, counter = F.col("text").rlike(r"\S"), "__abacorn_lines_removed"
    return dedup_lines(docs, counter).where(F.col("text").isNull() | (F.col(counter) == 0) | words).select(*docs.columns)
