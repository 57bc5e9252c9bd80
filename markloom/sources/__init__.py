"""Where documents come from: files as bytes, tables of pages, values."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: What Spark's binaryFile source gives; a stream needs it stated.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def binary_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """One row per file with its bytes; an empty file gives none. A missing path is an error."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html from Parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def values(spark: SparkSession, rows: Iterable[tuple[int, bytes]]) -> DataFrame:
    """doc_id, content from memory."""
    return spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, content binary")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one of a local session
    (tests); on a cluster that would be a folder of one machine, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            own = tempfile.mkdtemp(prefix="markloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[context.applicationId] = "file://" + own
        at = _OWN[context.applicationId]
    return at.rstrip("/")


def write_tokens(tokens: DataFrame, path: str) -> None:
    """The sink: tokens as Parquet."""
    tokens.write.parquet(path, mode="overwrite")
