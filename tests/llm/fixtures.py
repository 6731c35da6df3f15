"""Small documents for all operators: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = "the of river stone quiet lamp winter orange garden number seven little bridge morning paper glass".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"])
        out.append(w.capitalize() if k % 9 == 0 else w)
        if k % 9 == 8:
            out[-1] += "."
    return " ".join(out)


def documents(spark, rows, extra=True):
    """rows: (doc_id, text). The extra columns bear names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        names = ("score", "node", "n", "signature", "spans", "terms", "text_key", "length", "rank", "task", "batch", "quality", "__text")
        df = df.select("*", *(F.lit("x").alias(c) for c in names))
    return df


def odd_rows():
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, prose(2, 60)), (6, prose(2, 60)), (6, prose(2, 60)), (7, long), (8, "é\U0001f600 一二 à"), (9, "!!! ### 123"), (None, "no id at all"), (10, "a  b\n\n c\x00d")]
