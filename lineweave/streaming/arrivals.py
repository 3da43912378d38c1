"""Measures of files as they arrive: the batch operators keep no state between files, so they run on streams as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of files in a folder (binary), or of the rows of Parquet files if a schema is given."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if schema is not None:
        return reader.schema(schema).parquet(path)
    return reader.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def measured(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, available_now: bool = True):
    """Write an operator's rows for each batch of arrivals once, to Parquet; the query that does so."""
    writer = operator(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The stream without repeats of a key that come within ``late``: keyed state that a watermark keeps bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
