"""Files whose columns Spark cannot infer: the footer tells what to read them as and how to decode them.

Times, UUIDs, half floats, nanoseconds and decimals over 38 digits raise when Spark infers a schema; read as the numbers
or bytes that they are stored as, expressions turn them into values. Both the Arrow type and the Parquet logical type
of a column are asked, since writers differ in which of them says UUID.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError, explained
from ..functions import decode
from . import footer
from .scan import quoted, read_rows

_PLAIN: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "large_string": T.StringType(),
    "binary": T.BinaryType(),
    "large_binary": T.BinaryType(),
    "date32[day]": T.DateType(),
    "date64[ms]": T.DateType(),
}


def described(kind: pa.DataType, path: str, logical: dict[str, str]) -> dict:
    """A type as a tree of plain values: what to read it as (``spark``), how to decode it (``as``), and its parts. ``logical``: by leaf path."""
    if logical.get(path) == "UUID" or (isinstance(kind, pa.BaseExtensionType) and kind.extension_name == "arrow.uuid"):
        return {"spark": "binary", "as": "uuid"}
    if isinstance(kind, pa.BaseExtensionType):
        return described(kind.storage_type, path, logical)
    if pa.types.is_dictionary(kind):
        return described(kind.value_type, path, logical)
    if pa.types.is_struct(kind):
        return {"fields": [{"name": f.name, "nullable": f.nullable, **described(f.type, f"{path}.{f.name}", logical)} for f in kind]}
    if pa.types.is_map(kind):
        return {"key": described(kind.key_type, f"{path}.key_value.key", logical), "value": described(kind.item_type, f"{path}.key_value.value", logical)}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        # the item's name differs by writer
        at = next((p for p in logical if p.startswith(f"{path}.list.")), f"{path}.list.element")
        return {"item": described(kind.value_type, ".".join(at.split(".")[: path.count(".") + 3]), logical)}
    if pa.types.is_float16(kind):
        return {"spark": "binary", "as": "half"}
    if pa.types.is_time(kind):
        return {"spark": "int" if kind.unit == "ms" else "bigint", "as": {"ms": "time millis", "us": "time micros", "ns": "time nanos"}[kind.unit]}
    if pa.types.is_timestamp(kind):
        return {"spark": "bigint", "as": "nanos"} if kind.unit == "ns" else {"spark": "timestamp" if kind.tz else "timestamp_ntz"}
    if pa.types.is_decimal(kind):
        return {"spark": f"decimal({kind.precision},{kind.scale})"} if kind.precision <= 38 else {"spark": "binary", "as": f"decimal {kind.scale}"}
    if pa.types.is_fixed_size_binary(kind):
        return {"spark": "binary"}
    if str(kind) not in _PLAIN:
        raise SourceError(f"unsupported type {kind} of {path}")
    return {"spark": _PLAIN[str(kind)].simpleString()}


def _read_as(tree: dict) -> T.DataType:
    if "fields" in tree:
        return T.StructType([T.StructField(f["name"], _read_as(f), f["nullable"]) for f in tree["fields"]])
    if "key" in tree:
        return T.MapType(_read_as(tree["key"]), _read_as(tree["value"]))
    if "item" in tree:
        return T.ArrayType(_read_as(tree["item"]))
    kind = tree["spark"]
    if kind.startswith("decimal"):
        return T.DecimalType(*map(int, kind[8:-1].split(",")))
    return {"int": T.IntegerType(), "bigint": T.LongType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), **{k.simpleString(): k for k in _PLAIN.values()}}[kind]


def _plain(tree: dict) -> bool:
    return "as" not in tree and all(_plain(x) for x in [*tree.get("fields", ()), *(tree[k] for k in ("key", "value", "item") if k in tree)])


def decoded(c: Column, tree: dict) -> Column:
    """A column read as ``tree`` says, as values: UUIDs, times and wide decimals as text, half floats as doubles, nanoseconds as
    a struct of a timestamp and the nanoseconds left."""
    if _plain(tree):
        return c
    if "fields" in tree:
        return F.when(c.isNotNull(), F.struct(*[decoded(c.getField(f["name"]), f).alias(f["name"]) for f in tree["fields"]]))
    if "item" in tree:
        return F.transform(c, lambda x: decoded(x, tree["item"]))
    if "key" in tree:
        return F.transform_values(F.transform_keys(c, lambda k, v: decoded(k, tree["key"])), lambda k, v: decoded(v, tree["value"]))
    said, _, more = tree["as"].partition(" ")
    if said == "uuid":
        return decode.uuid_text(c)
    if said == "half":
        return decode.half_float(c)
    if said == "time":
        return decode.time_text(c, more)
    if said == "nanos":
        return F.when(c.isNotNull(), decode.nanos_timestamp(c))
    return decode.big_decimal_text(c, int(more))


def tree_of(spark: SparkSession, path: str) -> list[dict]:
    """The root columns of the first file at ``path``, described; its footer is read by an executor."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for p in b.column(0).to_pylist():
                with footer._open(p) as f:
                    logical = {f.schema.column(i).path: json.loads(f.schema.column(i).logical_type.to_json()).get("Type", "None") for i in range(len(f.schema))}
                    try:
                        said.append(json.dumps([{"name": x.name, "nullable": x.nullable, **described(x.type, x.name, logical)} for x in f.schema_arrow]))
                    except SourceError as e:
                        said.append(json.dumps(str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string())], ["tree"])

    with explained(f"reading {path}"):
        first = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where("path like '%.parquet'").orderBy("path").limit(1)
        row = first.mapInArrow(ask, "tree string").first()
    if row is None:
        raise SourceError(f"no Parquet file at {path}")
    tree: Any = json.loads(row["tree"])
    if isinstance(tree, str):
        raise SourceError(tree)
    return tree


def read_annotated(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows of files with any columns, decoded; ``columns`` as in ``read_rows``."""
    tree = [t for t in tree_of(spark, path) if columns is None or t["name"] in columns]
    df = read_rows(spark, path, schema=T.StructType([T.StructField(t["name"], _read_as(t), t["nullable"]) for t in tree]))
    return df.select(*[decoded(F.col(quoted(t["name"])), t).alias(t["name"]) for t in tree])
