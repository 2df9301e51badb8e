"""Small tables for the tests of the operators."""

import random

from pyspark.sql import functions as F

SYLLABLES = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "zu"]


def words(rng, n, size=3):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, size))) for _ in range(n)]


def docs_of(spark, rows):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text) pairs."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


LONG = " ".join(words(random.Random(5), 40_000)) + "."

ODD = [(1, None), (2, ""), (3, " \n\t\x0b "), (None, "a text without an id, of some words at least"), (4, "\n\n\n"),
       (5, "one"), (5, "one"), (6, "ONE two three"), (7, LONG), (7, LONG), (8, "Ünïcödé ß 漢字 🙂 x " * 9), (None, None)]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    d = docs_of(spark, ODD)
    for c in ("n", "key", "score", "held_out", "kept", "p", "grams", "label", "spans", "bucket", "rep", "count"):
        d = d.withColumn(c, F.lit("x"))
    return d


def no_docs(spark):
    return docs_of(spark, [])
