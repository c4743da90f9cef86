import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "b", 0), (3, " \n\t ", "fr", None, 3), (None, "no id but some words here to keep", "en", "a", 5), (4, long, "en", "a", len(long)),
        (5, "the same words in every copy of it", "en", "a", 1), (5, "the same words in every copy of it", "en", "a", 1), (6, "the same words in every copy of it", "de", "b", 1), (7, "!!! ???", "en", "c", 7), (8, "x" * 30_000, "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: "clash" for c in ("score", "kept", "node", "class_id", "bands", "spans", "n_words", "held_out", "sequence_id", "hash", "n_lines_removed", "path_", "item_id")}
    return df.selectExpr("*", *(f"'{v}' AS {k}" for k, v in clash.items()))
