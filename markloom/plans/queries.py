"""Queries by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom import operators as op
from markloom.functions import decode, patterns, preprocess, tokenize
from markloom.plans import fixtures as fx
from markloom.sources import binary_files, shared_dir, values, write_tokens

#: Byte sequences with what the matcher and the decoder say to them.
SEQUENCES = [
    ("UTF16BEBOM", "FEFF"),
    ("OPENMETA", "3C4D6554612F"),
    ("UTF16BEBOM", "FEFEFF"),
    ("UTF16BEBOM", "FE"),
    ("THREEC", "3C2F61"),
    ("THREEC", "3C7861"),
    ("THREEC", "3C613E"),
    ("UTF8BOM", "EFBBBF"),
    ("OPENCOMMENT", "3C212D2D"),
    ("XMLENCODING", "656E636F64696E67"),
]

#: Byte sequences of the decoder's tests; the last seven go on behind their error.
VECTORS = [
    "00", "7F", "C280", "DFBF", "E0A080", "EFBFBF", "F0908080", "F48FBFBF", "C080", "C1BF", "E08080", "F0808080", "C220", "E228A1", "F0288CBC",
    "C2", "E282", "F09080", "F5", "F6", "F7", "F8", "F9", "FA", "FB", "FC", "FD", "FE", "FF",
    "C241", "E228A141", "F528414243", "F490808041", "F7BFBFBF41", "EDA08041", "F480808041",
]


def src_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = binary_files(spark, f"{sf_dir}/nation.parquet")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def src_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = values(spark, [(i, bytes.fromhex(h)) for i, (_, h) in enumerate(SEQUENCES)])
    return df.select("doc_id", F.hex("content").alias("hex"), F.length("content").cast("long").alias("n"))


def _corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir).select("doc_id", fx.corrupted(F.col("text")).alias("content"))


def utf8_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = decode.utf8_decode(F.col("content"))
    return _corrupted(spark, sf_dir).select("doc_id", text.alias("text"))


def utf8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrupted where the id is odd."""
    df = fx.documents(spark, sf_dir)
    content = F.when(F.col("doc_id") % 2 == 1, fx.corrupted(F.col("text"))).otherwise(F.encode("text", "UTF-8"))
    return df.select("doc_id", decode.utf8_valid(content).alias("valid"))


def utf8_error_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrupted(spark, sf_dir).select("doc_id", decode.utf8_error_pos(F.col("content")).cast("long").alias("error_pos"))


def utf8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the decoder makes of each vector, and where it sees the first error."""
    df = values(spark, [(i, bytes.fromhex(h)) for i, h in enumerate(VECTORS)])
    text, at = decode.utf8_decode(F.col("content")), decode.utf8_error_pos(F.col("content"))
    return df.select("doc_id", F.hex("content").alias("hex"), F.hex(F.encode(text, "UTF-8")).alias("decoded"), at.cast("long").alias("error_pos"))


def _injected(spark: SparkSession, sf_dir: str, name: str, f: Callable[[Column], Column]) -> DataFrame:
    df = fx.documents(spark, sf_dir).select("doc_id", fx.injected(F.col("text")).alias("text"))
    return df.select("doc_id", f(F.col("text")).alias(name))


def pre_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "text", preprocess.sanitize)


def pre_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "text", preprocess.normalize_newlines)


def pre_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "text", preprocess.preprocess)


def pre_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, "sanitized_count", lambda t: preprocess.error_count(t).cast("long"))


def seq_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every pattern in the injected documents."""
    df = fx.documents(spark, sf_dir).select("doc_id", fx.injected(F.col("text")).alias("text"))
    return op.pattern_counts(df, "doc_id", F.encode("text", "UTF-8"), F.col("text"))


def seq_match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.pages(spark, sf_dir)
    return op.pattern_counts(df, "page_id", F.encode("html", "UTF-8"), F.col("html"))


def seq_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, n, bytearray.fromhex(h)) for i, (n, h) in enumerate(SEQUENCES)], "id long, name string, content binary")
    out = None
    for name in sorted({n for n, _ in SEQUENCES}):
        r = patterns.match_result(patterns.BY_NAME[name], F.col("content"))
        out = F.when(F.col("name") == name, r) if out is None else out.when(F.col("name") == name, r)
    return df.select("id", "name", out.alias("result"))


def seq_result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pattern says after the last character of a page that is cut off."""
    df = fx.pages(spark, sf_dir).select("page_id", fx.cut(F.col("html")).alias("html"))
    return op.pattern_results(df, "page_id", F.encode("html", "UTF-8"), F.col("html"))


def _seq_prefixed(spark: SparkSession, sf_dir: str, prefix: Column, name: str) -> DataFrame:
    content = F.concat(prefix, F.encode("text", "UTF-8"))
    return fx.documents(spark, sf_dir).select("doc_id", patterns.match_count(patterns.BY_NAME[name], content).cast("long").alias("n"))


def seq_open_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seq_prefixed(spark, sf_dir, F.encode(F.lit("<meta "), "UTF-8"), "OPENMETA")


def seq_utf16be_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seq_prefixed(spark, sf_dir, F.unhex(F.lit("FEFF")), "UTF16BEBOM")


def seq_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.catalogue(spark)
    one = lambda r: F.when(r[0] == r[1], r[0].cast("string")).otherwise(F.concat(r[0], F.lit("-"), r[1]))
    element = lambda e: F.concat(F.when(e["policy"] == "OPTIONAL", "?").otherwise(""), F.array_join(F.transform(e["ranges"], one), ","))
    return df.select("name", "domain", F.size("elements").cast("long").alias("n"), F.array_join(F.transform("elements", element), " ").alias("elements"))


def tok_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lexeme_rows(fx.pages(spark, sf_dir), "page_id", fx.strict(F.col("html")))


def tok_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.token_rows(fx.pages(spark, sf_dir), "page_id", fx.valued(F.col("html")))


def tok_tokens_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that end within a tag or text."""
    return op.token_rows(fx.pages(spark, sf_dir), "page_id", fx.cut(F.col("html")))


def sink_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(tok_tokens(spark, sf_dir), path)
    return spark.read.parquet(path)


def _kind(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op.of_kind(tok_tokens(spark, sf_dir), kind).drop("kind")


def tok_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page as it is, without what the dialect lacks, and cut off."""
    h = F.col("html")
    return tokenize.accepted_each(fx.pages(spark, sf_dir), ["page_id"], {"raw": h, "strict": fx.strict(h), "cut": fx.cut(h)})


def tok_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.token_errors(fx.pages(spark, sf_dir), "page_id", F.col("html"))


def tok_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of strict pages with one of eight faulty tags put in, by page id."""
    df = fx.pages(spark, sf_dir)
    faults = F.array(*map(F.lit, FAULTS))
    bad = F.concat(F.lit("<p>x"), F.get(faults, (F.col("page_id") % len(FAULTS)).cast("int")), fx.strict(F.col("html")))
    return op.token_errors(df, "page_id", bad)


#: A faulty tag for each code, and one without fault.
FAULTS = ["<?xml", "</>", "<a =c>", "<my-el>", "<a b >", "<a b=c/d>", '<a b="c">', "<i>"]


def tok_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_histogram(fx.pages(spark, sf_dir), "page_id", fx.valued(F.col("html")))


def tok_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to tokens through all stages: corrupted, injected documents between tags."""
    text = F.concat(F.lit("<doc id="), F.col("doc_id").cast("string"), F.lit("> "), fx.injected(F.col("text")), F.lit("</doc>"))
    df = fx.documents(spark, sf_dir).select("doc_id", F.encode(text, "UTF-8").alias("content"))
    df = op.normalized(op.decoded(df))
    return op.token_rows(df, "doc_id", F.col("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        src_binary, src_values, sink_tokens, utf8_vectors, utf8_decode, utf8_valid, utf8_error_pos, pre_sanitize, pre_newline, pre_full, pre_error_count,
        seq_match, seq_match_pages, seq_result, seq_result_pages, seq_open_meta, seq_utf16be_bom, seq_catalogue,
        tok_lexemes, tok_tokens, tok_tokens_cut, tok_accept, tok_error, tok_error_classes, tok_histogram, tok_pipeline,
    )
} | {
    "tok_opentag": _kind("OPENTAG"),
    "tok_closetag": _kind("CLOSETAG"),
    "tok_selfclose": _kind("SELFCLOSETAG"),
    "tok_tagname": _kind("TAGNAME"),
    "tok_attrname": _kind("ATTRNAME"),
    "tok_attrvalue": _kind("ATTRVALUE"),
    "tok_text": _kind("TEXTCONTENT"),
}
