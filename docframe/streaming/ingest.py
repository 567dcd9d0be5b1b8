"""Continuous use of the line, cleaning, extraction and chunk operators: they are stateless per document, so they run
unchanged on a stream. Late duplicates of a document are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def documents(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_documents(stream: DataFrame, id_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """The stream without repeated ids; state is kept for ``delay`` only."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def to_parquet(df: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends to a folder and ends when what has arrived is worked off."""
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
