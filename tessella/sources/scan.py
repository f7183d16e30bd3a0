"""Row scans, batch scans and projection of Parquet files."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, SourceError, explained


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_rows(spark: SparkSession, path: str, columns: Iterable[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """All rows. ``columns``: root columns to read, in the file's order; unknown names are ignored.

    ``schema``: what to read columns as that Spark cannot infer (times, nanoseconds, half floats, UUIDs, wide decimals).
    """
    with explained(f"reading {path}"):
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    return project(df, columns)


def project(df: DataFrame, columns: Iterable[str] | None) -> DataFrame:
    """Root columns by name, in the frame's order; the scan below reads no others."""
    if columns is None:
        return df
    wanted = set(columns)
    return df.select(*[quoted(c) for c in df.columns if c in wanted])


def numbered(df: DataFrame, name: str = "row_index", file: str = "file") -> DataFrame:
    """With each row's file and its place there."""
    return df.withColumns({name: F.col("_metadata.row_index"), file: F.col("_metadata.file_path")})


def batched(spark: SparkSession, path: str, batch_size: int, columns: Iterable[str] | None = None) -> DataFrame:
    """A row for each ``batch_size`` rows of a file: file, batch_id, and each column's values as an array in row order.

    An empty file gives one batch of empty arrays.
    """
    size = checked_size(batch_size)
    whole = read_rows(spark, path)
    df = project(whole, columns)
    names = df.columns
    meta = whole.select(*[quoted(c) for c in names], F.col("_metadata.row_index").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    rows = F.sort_array(F.collect_list(F.struct("_at", *[quoted(c) for c in names])))
    got = meta.groupBy(F.col("_file").alias("file"), F.floor(F.col("_at") / size).cast("long").alias("batch_id")).agg(rows.alias("_rows"))
    got = got.select("file", "batch_id", *[F.col("_rows").getField(c).alias(c) for c in names])
    # one row of empty arrays that only an empty input lets through
    none = spark.range(1).select(F.lit(path).alias("file"), F.lit(0).cast("long").alias("batch_id"), *[F.array().cast(T.ArrayType(df.schema[c].dataType)).alias(c) for c in names])
    there = whole.select(F.lit(1).alias("_there")).limit(1)
    return got.unionByName(none.join(F.broadcast(there), F.lit(True), "left_anti"))


def checked_size(batch_size: Any) -> int:
    if not isinstance(batch_size, int) or isinstance(batch_size, bool):
        raise ArgumentError("batch_size must be an integer")
    if batch_size <= 0:
        raise ArgumentError("batch_size must be greater than 0")
    return batch_size


def result_type(kind: str) -> str:
    if kind not in ("hash", "array"):
        raise ArgumentError(f"Invalid result type: {kind}")
    return kind


def spooled(spark: SparkSession, source: bytes | io.IOBase, folder: str) -> str:
    """Bytes or a stream as a file below ``folder``, a place that executors see; returns its path."""
    data = source if isinstance(source, (bytes, bytearray)) else source.read()
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.parquet"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A frame over a file that is surely readable; any other raises SourceError."""
    try:
        df = read_rows(spark, path)
        df.limit(1).count()
    except SourceError:
        raise
    except Exception as e:
        raise SourceError(f"cannot read {path}: {str(e).splitlines()[0]}") from e
    return df


def each_row(df: DataFrame, kind: str = "hash") -> Iterator[dict | tuple]:
    """Rows one by one at the driver's edge, a partition in memory at a time."""
    as_hash = result_type(kind) == "hash"
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True) if as_hash else tuple(r)
