"""Schemas: a builder, several notations, and an inspector, all over Spark's StructType.

What Spark's types cannot say (uuid, time units, nanoseconds, unsigned widths, date formats) is kept in a field's metadata under
``kind`` and ``format``, and for the parts of lists and maps likewise under ``item``, ``key`` and ``value``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaError

# The type names that callers may use, and what each is stored as.
NAMES: dict[str, tuple[T.DataType, str | None]] = {
    "boolean": (T.BooleanType(), None),
    "bool": (T.BooleanType(), None),
    "int8": (T.ByteType(), None),
    "int16": (T.ShortType(), None),
    "int32": (T.IntegerType(), None),
    "int64": (T.LongType(), None),
    "uint8": (T.ShortType(), "uint8"),
    "uint16": (T.IntegerType(), "uint16"),
    "uint32": (T.LongType(), "uint32"),
    "uint64": (T.DecimalType(20, 0), "uint64"),
    "float": (T.FloatType(), None),
    "float32": (T.FloatType(), None),
    "double": (T.DoubleType(), None),
    "float64": (T.DoubleType(), None),
    "string": (T.StringType(), None),
    "binary": (T.BinaryType(), None),
    "date": (T.DateType(), None),
    "date32": (T.DateType(), None),
    "date64": (T.DateType(), "date64"),
    "time_millis": (T.IntegerType(), "time_millis"),
    "time_micros": (T.LongType(), "time_micros"),
    "time_nanos": (T.LongType(), "time_nanos"),
    "timestamp": (T.TimestampType(), "millis"),
    "timestamp_second": (T.TimestampType(), "second"),
    "timestamp_millis": (T.TimestampType(), "millis"),
    "timestamp_micros": (T.TimestampType(), "micros"),
    "timestamp_nanos": (T.LongType(), "timestamp_nanos"),
}


def decimal(precision: int | None = None, scale: int | None = None) -> T.DecimalType:
    """Without a precision 38, without a scale 0."""
    p, s = 38 if precision is None else precision, 0 if scale is None else scale
    if s < 0:
        raise SchemaError(f"Invalid DECIMAL scale: {s}")
    if p < 1 or s > p:
        raise SchemaError(f"Invalid DECIMAL precision: {p}")
    if p > 38:
        raise SchemaError(f"decimal({p},{s}): more than 38 digits are stored as text or binary, not as a decimal")
    return T.DecimalType(p, s)


def _split(inner: str) -> list[str]:
    """The top-level parts of a comma-separated list."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(inner[at:i])
            at = i + 1
    return [*out, inner[at:]]


def parse_type(name: str, zoned: bool = True) -> tuple[T.DataType, dict]:
    """A type's name, nested ones included: ``list<int32>``, ``map<string,list<double>>``, ``decimal(9,2)``; with what Spark's type cannot say."""
    s = name.strip()
    low = s.lower()
    if m := re.fullmatch(r"list<(.+)>", low):
        item, meta = parse_type(m[1], zoned)
        return T.ArrayType(item, True), {"item": meta} if meta else {}
    if m := re.fullmatch(r"map<(.+)>", low):
        parts = _split(m[1])
        if len(parts) != 2:
            raise SchemaError(f"a map needs a key and a value: {s}")
        (key, key_meta), (value, value_meta) = (parse_type(x, zoned) for x in parts)
        return T.MapType(key, value, True), {k: v for k, v in (("key", key_meta), ("value", value_meta)) if v}
    if m := re.fullmatch(r"decimal(?:128|256)?(?:\((-?\d+)(?:\s*,\s*(-?\d+))?\))?", low):
        return decimal(*(None if x is None else int(x) for x in m.groups())), {}
    if m := re.fullmatch(r"fixed_len_byte_array\((\d+)\)", low):
        return T.BinaryType(), {"kind": f"fixed:{m[1]}"}
    if low not in NAMES:
        raise SchemaError(f"Unknown type: {s}")
    kind, said = NAMES[low]
    if isinstance(kind, T.TimestampType) and not zoned:
        kind = T.TimestampNTZType()
    meta = {} if said is None else {"kind": said}
    if said == "timestamp_nanos":
        meta["has_timezone"] = zoned
    return kind, meta


#: What a part of a schema may say in the dictionary notation.
PARTS = ("name", "type", "nullable", "item", "key", "value", "fields", "precision", "scale", "length", "format", "has_timezone", "timezone")


def node(spec: Any, zoned: bool = False) -> tuple[T.DataType, dict]:
    """A type from its name, a dictionary, a function that fills a struct, or a Spark type; with what Spark's type cannot say."""
    if isinstance(spec, T.DataType):
        return spec, {}
    if callable(spec):
        spec = {"type": "struct", "fields": spec}
    if isinstance(spec, str):
        spec = {"type": spec}
    if not isinstance(spec, dict):
        raise SchemaError(f"neither a type's name nor a dictionary: {spec!r}")
    if unknown := sorted(set(spec) - set(PARTS)):
        raise SchemaError(f"unknown keys: {unknown}")
    get = spec.get
    if get("type") is None:
        raise SchemaError("a type is missing")
    low = str(get("type")).lower()
    if get("has_timezone") is not None:
        zoned = bool(get("has_timezone"))
    elif get("timezone") is not None:
        zoned = bool(get("timezone"))
    if low in ("struct", "record"):
        inner, fields = Builder(zoned=False), get("fields")
        if callable(fields):
            fields(inner)
        else:
            for f in fields or ():
                inner.add(f)
        if not inner.fields:
            raise SchemaError("a struct needs fields")
        return T.StructType(inner.fields), {}
    # lists and maps of structs may give the struct's fields beside
    part = lambda k: {"type": "struct", "fields": get("fields")} if get("fields") is not None and get(k) in (None, "struct") else get(k)
    if low == "list":
        if part("item") is None:
            raise SchemaError("a list needs an item type")
        item, meta = node(part("item"))
        return T.ArrayType(item, True), {"item": meta} if meta else {}
    if low == "map":
        if get("key") is None or part("value") is None:
            raise SchemaError("a map needs a key and a value type")
        (key, key_meta), (value, value_meta) = node(get("key")), node(part("value"))
        return T.MapType(key, value, True), {k: v for k, v in (("key", key_meta), ("value", value_meta)) if v}
    if get("format") == "uuid":
        return T.StringType(), {"kind": "uuid", "format": "uuid"}
    if low in ("decimal", "decimal128", "decimal256") and (get("precision") is not None or get("scale") is not None):
        return decimal(get("precision"), get("scale")), {}
    kind, meta = parse_type(f"{low}({get('length')})" if low == "fixed_len_byte_array" and get("length") is not None else low, zoned)
    return kind, meta | ({"format": get("format")} if get("format") is not None else {})


class Builder:
    """Collects fields; ``field`` takes a type name or ``struct``, ``list`` or ``map`` with their parts, which may be dictionaries."""

    def __init__(self, zoned: bool = True):
        self.fields: list[T.StructField] = []
        self.zoned = zoned

    def field(self, name: str, type: str, nullable: bool = True, **parts: Any) -> Builder:
        return self.add({"name": name, "type": type, "nullable": nullable, **parts})

    def add(self, spec: dict) -> Builder:
        name, nullable = spec.get("name"), spec.get("nullable", True)
        if name is None:
            raise SchemaError(f"a field needs a name: {spec}")
        if any(f.name == name for f in self.fields):
            raise SchemaError(f"Duplicate field name: {name}")
        kind, meta = node(spec, self.zoned)
        self.fields.append(T.StructField(name, kind, nullable, meta))
        return self


def define(fill: Callable[[Builder], Any]) -> T.StructType:
    """A schema from calls of ``field`` on a builder."""
    b = Builder()
    fill(b)
    if not b.fields:
        raise SchemaError("a schema needs fields")
    return T.StructType(b.fields)


def normalise(schema: Any, width: int | None = None) -> T.StructType:
    """Any notation: a StructType, ``[{name: type}]``, ``[{"name":, "type":}]``, ``{"fields": [...]}``, or nothing (f0, f1, ... as strings)."""
    if isinstance(schema, T.StructType):
        return schema
    if not schema:
        if not width:
            raise SchemaError("without a schema there must be a row to count columns in")
        return T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width)])
    if isinstance(schema, dict):
        return normalise(schema.get("fields") or [])
    b = Builder(zoned=not any("name" in f for f in schema))
    for f in schema:
        if "name" in f:
            b.add(f)
        elif len(f) == 1:
            ((name, kind),) = f.items()
            if not isinstance(kind, str):
                raise SchemaError(f"the type of {name} must be a name")
            b.field(name, kind)
        else:
            raise SchemaError(f"one column in each entry, not {sorted(f)}")
    return T.StructType(b.fields)


_PLAIN = {"boolean": "boolean", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double", "string": "string", "binary": "binary", "date": "date32", "timestamp": "timestamp_micros", "timestamp_ntz": "timestamp_micros"}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.MapType):
        return "map"
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    return _PLAIN[kind.simpleString()]


def requires_format(kind: T.DataType) -> bool:
    """Whether text of this type needs a pattern to be read exactly."""
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType))


_WORDS = {"float": "float32", "double": "float64"}


def to_dict(kind: T.DataType, name: str | None = None, nullable: bool = True, meta: dict | None = None) -> dict:
    """The dictionary notation of a schema or a part of one; ``normalise`` reads it back."""
    meta = meta or {}
    said, format = meta.get("kind"), meta.get("format")
    out: dict[str, Any] = {} if name is None else {"name": name}
    if said == "uuid":
        out |= {"type": "fixed_len_byte_array", "length": 16}
    elif said and said.startswith("fixed:"):
        out |= {"type": "fixed_len_byte_array", "length": int(said[6:])}
    elif isinstance(kind, T.DecimalType) and said is None:
        out |= {"type": "decimal128", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out |= {"type": f"timestamp_{said or 'micros'}", "has_timezone": isinstance(kind, T.TimestampType)}
    elif said in NAMES:
        out["type"] = said
        if "has_timezone" in meta:
            out["has_timezone"] = meta["has_timezone"]
    else:
        out["type"] = _WORDS.get(type_name(kind), type_name(kind))
    out["nullable"] = nullable
    if format is not None:
        out["format"] = format
    if isinstance(kind, T.StructType):
        out["fields"] = [to_dict(f.dataType, f.name, f.nullable, f.metadata) for f in kind]
    elif isinstance(kind, T.ArrayType):
        out["item"] = to_dict(kind.elementType, nullable=kind.containsNull, meta=meta.get("item"))
    elif isinstance(kind, T.MapType):
        out |= {"key": to_dict(kind.keyType, nullable=False, meta=meta.get("key")), "value": to_dict(kind.valueType, nullable=kind.valueContainsNull, meta=meta.get("value"))}
    return out


def _parts(kind: T.DataType) -> list[tuple[str, T.DataType, bool]]:
    if isinstance(kind, T.StructType):
        return [(f.name, f.dataType, f.nullable) for f in kind]
    if isinstance(kind, T.ArrayType):
        return [("item", kind.elementType, kind.containsNull)]
    if isinstance(kind, T.MapType):
        return [("key", kind.keyType, False), ("value", kind.valueType, kind.valueContainsNull)]
    return []


def walk(kind: T.DataType, path: str = "") -> Iterator[tuple[str, T.DataType, bool]]:
    """Every part of a schema below its root, depth first, with its dotted path."""
    for name, part, nullable in _parts(kind):
        here = f"{path}.{name}" if path else name
        yield here, part, nullable
        yield from walk(part, here)


def field_count(schema: T.StructType) -> int:
    """The fields at the root and inside nested structs."""
    return sum(1 for _ in walk(schema))


def find(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a dotted path (``item``, ``key`` and ``value`` step into lists and maps)."""
    kind: T.DataType = schema
    for step in path.split("."):
        kind = next((part for name, part, _ in _parts(kind) if name == step), None)
        if kind is None:
            return None
    return kind
