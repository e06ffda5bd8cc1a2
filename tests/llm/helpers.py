"""Rows that every operator on texts must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

LONG = " ".join(f"w{k % 997}x{k}" for k in range(60_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta " * 10, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "en", "b"),
    (6, "one\nTwo\ntwo \nthree\n\n" + PASSAGE, "fr", "b"),
    (7, PASSAGE + " and more of it", "en", None),
    (8, "repeated row of a few words", "en", "a"),
    (8, "repeated row of a few words", "en", "a"),
    (9, "repeated row of a few words", None, "c"),
    (10, "Ünïcödé 漢字 ▁ 🙂 words", "xx", "c"),
    (None, "a row without an id " + PASSAGE, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def edge_docs(spark, clash=()):
    """The rows, with further columns of the given names."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in clash}) if clash else df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
