"""Documents with what an operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = ["n_words", "size", "target", "taken", "kept", "score", "fingerprint", "component_id", "failures", "__mark", "found", "items", "lang_pred", "held_out", "n_tokens", "__key", "__gone", "__goes", "__hash", "__id", "__size", "__range", "__source", "__start", "__found", "__n", "__n_gone", "__words_gone", "__hit", "mark", "stays"]


def words(rng, n, pool="the of and re thion anst eau über ñado 12 x".split()):
    return " ".join("".join(rng.choices(pool, k=rng.randint(1, 3))) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = words(rng, 90)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # a repeated row
        (3, base.replace("the", "THE", 1), "en", None, 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n\x0b ", "en", "b", 0),
        (7, "one two", "en", "b", 0),
        (8, "!!! ### 123 45", None, "b", 0),
        (9, words(rng, 20000), "fr", "c", 0),
        (None, "no id but words " * 20, "en", "c", 0),
        (None, None, None, "c", 0),
        (10, "line one here now ok\nline two is it\n\nline one here now ok\n" + words(rng, 60), "en", "c", 0),
        (11, "\x85   x\x1cy é è́ 日本語 <|endoftext|> a<|endoftext|>", "xx", "ü", 0),
        (12, "a b c a b c a b c", "en", "b", 0),
    ]
    rows += [(100 + k, words(rng, rng.randint(1, 200)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d"]), k) for k in range(60)]
    rows += [(200 + k, rows[20 + k][1] + " " + words(rng, 1), "en", "a", k) for k in range(10)]
    return rows


def frame(spark, rows=None, clash=False, partitions=3):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(partitions)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])
    return df
