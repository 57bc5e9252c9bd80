"""The same expressions over a stream of files: each file is a row, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.operators import decoded, normalized, token_rows
from markloom.sources import FILE_SCHEMA


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def token_stream(files: DataFrame) -> DataFrame:
    """Files to path, pos, kind, value; works on batches too."""
    return token_rows(normalized(decoded(files)), "path", F.col("text"))


def write_stream(tokens: DataFrame, path: str, checkpoint: str):
    """Parquet, everything there is, then stop."""
    return tokens.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
