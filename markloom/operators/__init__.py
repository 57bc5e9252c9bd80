"""DataFrame operators: stages over tables of documents. All are narrow; nothing here shuffles but histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions import patterns as pt
from markloom.functions import tokenize as tk
from markloom.functions.decode import utf8_decode, utf8_error_pos
from markloom.functions.preprocess import error_count, preprocess


def decoded(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds text and error_pos."""
    return docs.withColumn("text", utf8_decode(F.col(content))).withColumn("error_pos", utf8_error_pos(F.col(content)))


def normalized(docs: DataFrame, text: str = "text", max_codepoints: int | None = None) -> DataFrame:
    """Replaces text by its preprocessed form and adds the number of characters dropped.
    max_codepoints cuts the result, as an engine with buffers of fixed size would; without it nothing is lost."""
    c = preprocess(F.col(text))
    c = F.substring(c, 1, max_codepoints) if max_codepoints else c
    return docs.withColumn("sanitized_count", error_count(F.col(text))).withColumn(text, c)


def exploded(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    """posexplode of `all`. The outer form with a filter behind it: for the inner one Spark adds a filter on the
    array before it, and pushing that down evaluates all the expressions that make the array once more."""
    return df.select(*keep, F.posexplode_outer("all").alias("pos", name)).filter(F.col("pos").isNotNull())


def lexeme_rows(docs: DataFrame, key: str, text: Column) -> DataFrame:
    return exploded(docs.select(key, tk.lexemes(text).alias("all")), [key], "lexeme")


def token_rows(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, kind, value: a row per token, in the order of pos."""
    return tk.tokenized(docs, [key], text).transform(exploded, [key], "t").select(key, "pos", "t.kind", "t.value")


def of_kind(tokens: DataFrame, kind: str) -> DataFrame:
    return tokens.filter(F.col("kind") == kind)


def token_errors(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, error, offset (of the character where it shows): a row per document that leaves the dialect."""
    rows = tk.split_up(docs, [key], text).filter(F.col("left").isNotNull())
    rows = rows.select(key, "left", tk.error(F.col("left.rest")).alias("e")).filter(F.col("e").isNotNull())
    return rows.select(key, F.col("e.code").alias("error"), (F.col("left.offset") + F.col("e.size") - 1).alias("offset"))


def histogram(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.groupBy(key, "kind").agg(F.count("*").alias("n"))


def page_histogram(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Like histogram(token_rows(...)) where key is unique, but counted in the row: no shuffle and no row per token."""
    rows = tk.tokenized(docs, [key], text).select(key, F.col("all.kind").alias("all"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.filter("all", F.lit(k).__eq__)).cast("long").alias("n")) for k in tk.KINDS])
    counts = rows.select(key, F.filter(each, lambda x: x["n"] > 0).alias("all"))
    return exploded(counts, [key], "c").select(key, "c.kind", "c.n")


def pattern_counts(docs: DataFrame, key: str, content: Column, text: Column) -> DataFrame:
    """key, name, n for every pattern of the catalogue that matches."""
    each = [F.struct(F.lit(p.name).alias("name"), pt.match_count(p, content if p.domain == "byte" else text).cast("long").alias("n")) for p in pt.CATALOGUE]
    rows = docs.select(key, F.filter(F.array(*each), lambda m: m["n"] > 0).alias("all"))
    return exploded(rows, [key], "m").select(key, "m.name", "m.n")


def pattern_results(docs: DataFrame, key: str, content: Column, text: Column) -> DataFrame:
    """key, name, result for every pattern of the catalogue."""
    each = [F.struct(F.lit(p.name).alias("name"), pt.match_result(p, content if p.domain == "byte" else text).alias("result")) for p in pt.CATALOGUE]
    return docs.select(key, F.explode(F.array(*each)).alias("m")).select(key, "m.name", "m.result")


def catalogue(spark) -> DataFrame:
    """name, domain, elements: the patterns as a table."""
    rows = [(p.name, p.domain, [("OPTIONAL" if e.optional else "MANDATORY", [[a, b] for a, b in e.values]) for e in p.elements]) for p in pt.CATALOGUE]
    return spark.createDataFrame(rows, "name string, domain string, elements array<struct<policy:string,ranges:array<array<int>>>>")
