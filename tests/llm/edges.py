"""Small tables that hold every awkward row at once."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that operators use inside.
CLASH = ("score", "start", "size", "fp", "label", "bucket", "own", "uses", "block", "key", "digest",
         "_away_id", "_away_digest", "_away_hash", "_mix_id", "_mix_uses", "_text_hash", "_digest", "_score", "blocks")

LONG = "lorem ipsum dolor sit amet the quick brown fox of the lazy dog. " * 3000


def rows(extra=()):
    plain = [
        (1, "The cat of the house sat on a mat and the dog looked at it."),
        (2, None), (3, ""), (4, "   \n\t "), (5, LONG),
        (6, "The cat of the house sat on a mat and the dog looked at it."),
        (6, "The cat of the house sat on a mat and the dog looked at it."),
        (7, "word"), (8, "two words"), (9, "!!! ??? --- ***"),
        (None, "a row without an id"), (None, None), (10, LONG),
        (11, "ÀÉ straße 中文 \x1c tab\tand nbsp  two spaces\n\nand lines"),
        (12, "Licensed under the Apache License, Version 2.0."),
    ]
    return [
        (i, t, "en", None if k % 5 == 4 else f"src{k % 3}", None if t is None else len(t))
        for k, (i, t) in enumerate([*plain, *extra])
    ]


def documents(spark, extra=(), clash=True):
    df = spark.createDataFrame(rows(extra), DOCS).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for name in CLASH:
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
