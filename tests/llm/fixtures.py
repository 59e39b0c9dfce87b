"""Rows that every operator must take: NULLs, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "uid", "key", "root", "n", "kept", "keep", "score", "ids", "part", "row", "window", "tokens", "tkey", "item", "hash", "h", "w", "spans", "found", "component_id", "label", "size")


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def edge_rows():
    long = prose(1, 20_000)
    rows = [(1, "Plain text, don't panic.\nSecond line", "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
            (5, long, "en", "a", len(long)), (6, long, "en", "a", len(long)), (None, "No id here", "en", "b", 10), (None, None, None, None, None),
            (7, "same row", "de", "c", 8), (7, "same row", "de", "c", 8), (8, "one", "fr", "c", 3), (9, "Ünïcödé ﬁ — ж ́x  tail ", "xx", None, 5),
            (10, "<|endoftext|> token: 'abc'", "en", "a", 5), (-3, "Negative id", "en", "a", 11), (11, "x" * 5000, "en", "b", 5000)]
    return rows


def edge_docs(spark, rows=None):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
