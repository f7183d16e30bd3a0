"""Parquet sinks: rows or columns in, one file or a folder out."""

from __future__ import annotations

import io
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, SchemaError, TessellaError, explained
from ..functions import coerce
from ..plans import schema as schemas
from .scan import quoted

# Codec names, and Spark's for them. "lz4" means the raw framing that other readers know.
CODECS = {"none": "none", "uncompressed": "none", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "lz4_raw": "lz4_raw", "zstd": "zstd", "brotli": "brotli"}


def codec(name: str | None) -> str:
    if name is None:
        return "snappy"
    if name.lower() not in CODECS:
        raise ArgumentError(f"Invalid compression option: {name}")
    return CODECS[name.lower()]


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the schema's columns and types, matched by name; nulls in required columns raise with their path."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")

    def column(f: T.StructField) -> Column:
        c = coerce.to_type(F.col(quoted(f.name)), f.dataType, f.metadata, df.schema[f.name].dataType)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"Found null value for non-nullable field at {f.name}")).cast(f.dataType))
        return c.alias(f.name, metadata=f.metadata)

    return df.select(*[column(f) for f in schema])


def write(df: DataFrame, path: str, compression: str | None = None, schema: T.StructType | None = None, row_group_bytes: int | None = None, dictionary: bool | None = None, version: str | None = None, mode: str = "errorifexists") -> None:
    """A folder of Parquet files; a failed write leaves nothing that reads."""
    out = df if schema is None else conformed(df, schema)
    w = out.write.mode(mode).option("compression", codec(compression))
    for key, value in (("parquet.block.size", row_group_bytes), ("parquet.enable.dictionary", None if dictionary is None else str(dictionary).lower()), ("parquet.writer.version", version)):
        if value is not None:
            w = w.option(key, value)
    with explained(f"writing {path}"):
        w.parquet(path)


def write_file(df: DataFrame, path: str, **options: Any) -> None:
    """One file at exactly ``path``, which is one task's work: for results that fit one."""
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    write(df.coalesce(1), beside, **options)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(beside)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    fs.delete(folder, True)


def write_stream(df: DataFrame, target: io.IOBase, folder: str, **options: Any) -> int:
    """One file's bytes into an open binary stream, by way of a file below ``folder``, a place that executors see; returns how many."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.parquet"
    write_file(df, path, **options)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    try:
        data = bytes(df.sparkSession.read.format("binaryFile").load(path).first()["content"])
        target.write(data)
    finally:
        fs.delete(place, True)
    return len(data)


class Writer:
    """Frames written one after another, which become readable together when it closes; an error inside a ``with`` leaves nothing."""

    def __init__(self, spark: SparkSession, path: str, **options: Any):
        self.spark, self.path, self.options = spark, path, options
        self.staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        self.closed = False

    def _fs(self, path: str) -> tuple[Any, Any]:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def write(self, df: DataFrame) -> Writer:
        if self.closed:
            raise TessellaError(f"the writer of {self.path} is closed")
        write(df, self.staged, mode="append", **self.options)
        return self

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        fs, staged = self._fs(self.staged)
        if fs.exists(staged) and not fs.rename(staged, self._fs(self.path)[1]):
            raise TessellaError(f"cannot move {self.staged} to {self.path}")

    def abort(self) -> None:
        self.closed = True
        fs, staged = self._fs(self.staged)
        fs.delete(staged, True)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.close() if kind is None else self.abort()


def rows_frame(spark: SparkSession, rows: list, schema: Any = None) -> DataFrame:
    """Rows (sequences or dicts) as a frame in the schema's types; all strings f0, f1, ... without one."""
    if not rows and not schema:
        raise ArgumentError("neither rows nor a schema")
    target = schemas.normalise(schema, len(rows[0]) if rows else None)
    for i, r in enumerate(rows):
        if not isinstance(r, dict) and len(r) != len(target):
            raise SchemaError(f"row {i} has {len(r)} values, the schema {len(target)}")
    text = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else T.StringType()) for f in target])

    def plain(v: Any, f: T.StructField) -> Any:
        if v is None or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return v
        return v.decode("latin-1") if isinstance(v, bytes) else str(v)

    data = [[plain(r.get(f.name) if isinstance(r, dict) else r[k], f) for k, f in enumerate(target)] for r in rows]
    return conformed(spark.createDataFrame(data, text), target)


def zipped(batches: DataFrame, names: list[str]) -> DataFrame:
    """Column arrays as rows, batch by batch; arrays of unequal length raise."""
    even = F.lit(True)
    for n in names[1:]:
        even = even & (F.size(quoted(n)) == F.size(quoted(names[0])))
    first = F.when(even, F.arrays_zip(*[F.col(quoted(n)) for n in names])).otherwise(F.raise_error(F.lit("columns of a batch differ in length")))
    return batches.select(F.posexplode(first).alias("_at", "_row")).select("_at", *[F.col("_row").getField(n).alias(n) for n in names])
