"""Small fixtures for the corpus operators."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, row string, rank int, k string, stat_upper double"

EN = "the quick brown fox jumps over the lazy dog and runs into the deep green forest where nobody lives any more"
LONG = " ".join(f"word{i % 977} is here" for i in range(9000))


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", 1, "k", 0.5) for i, t in rows], DOCS)


def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a word without an end."""
    rows = [
        (1, EN), (2, EN), (3, EN.replace(" ", "\n\t ")), (4, EN + " x"), (5, None), (6, ""), (7, " \t\n "), (8, "..."),
        (9, LONG), (10, LONG + " end"), (11, "a" * 30000), (12, "one two"), (13, "One  TWO"), (14, "日本語 テキスト é́   ß"),
        (15, "x"), (1, EN), (None, EN), (None, None),
    ]
    nothing = spark.createDataFrame([(None,) * 10], DOCS)
    return docs(spark, rows).union(nothing)


def empty(spark):
    return spark.createDataFrame([], DOCS)
