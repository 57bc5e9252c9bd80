"""Deterministic inputs derived from the tables, in Spark and in SQL: dialects of pages, injected and corrupted documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STRIPPED = (r"(?s)<!--.*?-->", r"(?s)<script>.*?</script>", r"(?s)<style>.*?</style>")
_QUOTED, _VALUED = r'="[^"]*"', r'="([A-Za-z0-9]*)[^"]*"'
#: Tags that close themselves in the valued form.
_VOID = r"<(meta|link|img|br|li)( [^<>/]*)?>"


def _strip(html: Column) -> Column:
    for p in _STRIPPED:
        html = F.regexp_replace(html, F.lit(p), F.lit(""))
    return html


def strict(html: Column) -> Column:
    """Pages without what the dialect lacks; attributes lose their values."""
    return F.regexp_replace(_strip(html), F.lit(_QUOTED), F.lit(""))


def valued(html: Column) -> Column:
    """Like strict, but what is alphanumeric at the start of a value stays, and some tags close themselves."""
    return F.regexp_replace(F.regexp_replace(_strip(html), F.lit(_VALUED), F.lit("=$1")), F.lit(_VOID), F.lit("<$1$2/>"))


def cut(html: Column) -> Column:
    """valued, cut off before its last seven characters."""
    return F.regexp_replace(valued(html), F.lit(r"(?s).{0,7}\z"), F.lit(""))


def injected(text: Column) -> Column:
    """CR LF, CR, U+0085 and U+FDD0 put into a text."""
    out = F.replace(text, F.lit(". "), F.lit(".\r\n"))
    out = F.replace(out, F.lit(", "), F.lit(",\r"))
    out = F.replace(out, F.lit("a"), F.lit("a\x85"))
    return F.replace(out, F.lit("o "), F.lit("o﷐"))


def corrupted(text: Column) -> Column:
    """Bytes of a text with pieces of malformed sequences put in."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.unhex(F.concat(F.substring(h, 1, 20), F.lit("E282"), F.substring(h, 21, 40), F.lit("F5"), F.substring(h, 61, 10), F.lit("C0"), F.substring(h, F.lit(71), F.length(h))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def _spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Over the cores, where the files give fewer partitions (small tables only): the work per byte is high."""
    want = spark.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def _sql_strip() -> str:
    out = "html"
    for p in _STRIPPED:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return out


SQL_STRICT = f"regexp_replace({_sql_strip()}, '{_QUOTED}', '', 'g')"
SQL_VALUED = rf"regexp_replace(regexp_replace({_sql_strip()}, '{_VALUED}', '=\1', 'g'), '{_VOID}', '<\1\2/>', 'g')"
SQL_CUT = f"regexp_replace({SQL_VALUED}, '(?s).{{0,7}}\\z', '')"
SQL_INJECTED = "replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)), 'a', 'a' || chr(133)), 'o ', 'o' || chr(64976))"
_H = "hex(encode(text))"
SQL_CORRUPTED_HEX = f"concat(substr({_H}, 1, 20), 'E282', substr({_H}, 21, 40), 'F5', substr({_H}, 61, 10), 'C0', substr({_H}, 71))"
