"""Small documents with the cases that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed=0, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["an", "er", "th", "ou", "st", "ing", "bel", "kor"]) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def documents(spark, extra=(), clash=True):
    base = prose(120, 1)
    rows = [
        (0, base, "en", "a", None), (1, base, "en", "a", 1), (2, base.replace("an", "AN", 1), "en", "b", 2), (3, prose(80, 2), None, None, 3),
        (4, None, "en", "a", None), (5, "", None, "b", 0), (6, " \t\n", "de", "b", 3), (7, "one", "de", None, 3), (8, prose(6000, 3), "de", "c", None),
        (9, "wörter über straße é ü 漢字 😀 a\u0000b", "de", "c", None), (None, prose(60, 4), None, "a", 5), (0, base, "en", "a", None), (10, "a " * 300, "en", "d", None), (11, "[]{}\\|<|im_end|>", "en", "d", None),
        *extra,
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for name in ("size", "fp", "fingerprint", "score", "row", "key", "h", "t", "part", "at", "secrets", "component", "rejected", "ids", "shard", "copy"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
