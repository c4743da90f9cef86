"""The queries of this subpackage, each over its whole table: callables by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacorn.llm import decontam, langid, licenses, lines, neardup, packing, pages, repetition, secrets, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_lines_removed")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is the file source/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.when(F.col("source").isNotNull() & F.col("doc_id").isNotNull(), F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_repetition": op2_repetition,
    "op3_pack": op3_pack,
    "op4_secrets": op4_secrets,
    "op5_main_text": op5_main_text,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_language": op8_language,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM d WHERE text IS NOT NULL),
b AS (SELECT doc_id, source, i, parts[i] AS raw, trim(parts[i], ' ' || chr(9) || chr(13)) AS line FROM l),
c AS (SELECT *, regexp_matches(line, '{lines.COUNTS}') AS counts FROM b),
s AS (SELECT line, min(doc_id) AS first FROM c WHERE counts GROUP BY line HAVING count(DISTINCT source) >= {lines.SITES}),
h AS (SELECT c.*, s.first, row_number() OVER (PARTITION BY c.line, c.doc_id ORDER BY i) AS nth FROM c LEFT JOIN s ON c.counts AND s.line = c.line),
k AS (SELECT *, first IS NULL OR (first = doc_id AND nth = 1) AS stays FROM h),
t AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, t.text, CAST(length(t.text) AS BIGINT) AS n_chars, coalesce(t.n, 0) AS n_lines_removed FROM d LEFT JOIN t USING (doc_id)
""",
}
