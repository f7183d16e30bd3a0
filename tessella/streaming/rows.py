"""Incremental scans: the same projection over files as they arrive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.scan import project


def stream_rows(spark: SparkSession, folder: str, schema: T.StructType, columns: Iterable[str] | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """An unbounded frame over a folder's Parquet files, each read once."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return project(reader.parquet(folder), columns)
