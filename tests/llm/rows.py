"""Awkward rows for every operator: nulls, empty and long texts, repeated rows, columns whose names clash."""

from pyspark.sql import functions as F

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "my"]


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefghij") for _ in range(n))


TEXTS = [(1, prose(1, 80)), (2, None), (3, ""), (4, "   \n\t "), (5, prose(1, 80)), (5, prose(1, 80)), (6, prose(2, 30_000)), (7, "x" * 300_000), (None, prose(3, 60)), (8, "日本語 ÉÉ ß İ ﬁ ́x 🙂"), (9, "a"), (10, prose(1, 79) + " changed"), (11, "!!! 123 ???")]
CLASH = ["rid", "w", "spans", "items", "gram", "len", "h", "d", "s0", "fp", "component_id", "low", "evidence", "host", "path", "score", "keep", "p", "good", "bucket", "held_out", "word", "c", "x_0", "canon", "fingerprint", "at", "n_words", "label"]


def awkward(spark, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(2)
    df = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx")).withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def stored(spark, df, tmp_path, name="docs"):
    """Operators that scan twice take files."""
    path = str(tmp_path / name)
    df.write.parquet(path, mode="overwrite")
    return spark.read.parquet(path)


def empty(spark):
    return awkward(spark).limit(0)
