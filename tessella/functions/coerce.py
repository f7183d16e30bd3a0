"""From a caller's values to a column's type, as Catalyst expressions. Values out of range raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError

UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
_WIDE = {"uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}
# Directives of strftime and the letters of Java's patterns for them.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%e": "d"}


def guarded(c: Column, ok: Column, said: str) -> Column:
    """``c`` where ``ok`` holds or ``c`` is null; raises ``said`` elsewhere."""
    return F.when(c.isNull() | ok, c).otherwise(F.raise_error(F.concat(F.lit(said + ": "), c.cast("string"))).cast("string"))


def integer(c: Column, kind: str, lenient: bool = False) -> Column:
    """int8 to int64, numeric text included; ``lenient`` gives null where the strict form raises."""
    spark = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}[kind]
    text = F.trim(c.cast("string"))
    return text.try_cast(spark) if lenient else text.cast(spark)


def unsigned(c: Column, kind: str) -> Column:
    n = F.trim(c.cast("string")).cast("decimal(20,0)")
    return F.when(n.isNull() | n.between(F.lit(0), F.lit(str(UNSIGNED[kind])).cast("decimal(20,0)")), n).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {kind}: "), n.cast("string"))).cast("decimal(20,0)")).cast(_WIDE[kind])


def boolean(c: Column) -> Column:
    return c.cast("boolean")


def floating(c: Column, kind: str = "double") -> Column:
    return c.cast(kind)


def text(c: Column) -> Column:
    """Any value as text; bytes that are not UTF-8 raise."""
    return F.validate_utf8(c.cast("string"))


def binary(c: Column) -> Column:
    return c.cast("binary")


def fixed(c: Column, n: int) -> Column:
    """Exactly ``n`` bytes."""
    b = c.cast("binary")
    return F.when(b.isNull() | (F.octet_length(b) == n), b).otherwise(F.raise_error(F.concat(F.lit(f"{n} bytes are asked for, not "), F.octet_length(b).cast("string"))).cast("binary"))


def uuid_bytes(c: Column) -> Column:
    """A UUID in text, with or without hyphens and in any case, as 16 bytes."""
    bare = F.lower(F.replace(F.trim(c), F.lit("-"), F.lit("")))
    return F.unhex(F.when(c.isNull() | bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.raise_error(F.concat(F.lit("not a UUID: "), c))))


def decimal(c: Column, precision: int, scale: int) -> Column:
    """Extra digits are cut off, not rounded: -1.239 at scale 2 is -1.23."""
    if scale < 0:
        raise ArgumentError(f"Invalid DECIMAL scale: {scale}")
    s = F.trim(c.cast("string"))
    plain = F.when(s.rlike("[eE]"), s.cast("double").cast("decimal(38,15)").cast("string")).otherwise(s)
    return F.regexp_replace(plain, rf"([.][0-9]{{0,{scale}}})[0-9]*$", "$1").cast(T.DecimalType(precision, scale))


def java_pattern(strftime: str) -> str:
    """A strftime pattern in Java's letters."""
    out, i = "", 0
    while i < len(strftime):
        two = strftime[i : i + 2]
        if strftime[i] == "%":
            if two not in DIRECTIVES:
                raise ArgumentError(f"unsupported directive {two}")
            out += DIRECTIVES[two]
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]
            i += 1
    return out


def date(c: Column, format: str | None = None) -> Column:
    """Text by a strftime pattern, or in one of three common shapes; null where none fits and no pattern was given."""
    if format is not None:
        return F.to_date(c, java_pattern(format))
    return F.coalesce(*[F.try_to_date(c, p) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MMM d, yyyy")])


def time_of_day(c: Column, unit: str) -> Column:
    """The time of day of a timestamp as a count of ``millis``, ``micros`` or ``nanos``."""
    micros = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), c).cast("decimal(8,6)") * 1_000_000).cast("long")
    if unit == "millis":
        return F.floor(micros / 1000).cast("int")
    return micros if unit == "micros" else micros * 1000


def offset(c: Column) -> Column:
    """The offset from UTC that ISO 8601 text ends with, as +HH:MM; null without one."""
    found = F.regexp_extract(c, "(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$", 1)
    parts = F.regexp_extract(found, "^([+-][0-9]{2}):?([0-9]{2})?$", 1), F.regexp_extract(found, "^([+-][0-9]{2}):?([0-9]{2})?$", 2)
    there = c.rlike("[T ][0-9:.]+(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    return F.when(there & (found == "Z"), F.lit("+00:00")).when(there, F.concat(parts[0], F.lit(":"), F.rpad(parts[1], 2, "0")))


def timestamp(c: Column, unit: str = "micros", zoned: bool = True) -> Column:
    """A timestamp, or ISO 8601 text with any offset, in UTC; digits under ``unit`` are cut off. ``nanos``: a long."""
    ts = c.cast("timestamp")
    if unit == "nanos":
        return F.unix_micros(ts) * 1000
    cut = {"second": F.date_trunc("SECOND", ts), "millis": F.date_trunc("MILLISECOND", ts), "micros": ts}[unit]
    return cut if zoned else cut.cast("timestamp_ntz")


def to_type(c: Column, kind: T.DataType, meta: dict | None = None, given: T.DataType | None = None) -> Column:
    """A value in a field's type; lists, maps and structs by their parts. Missing struct fields are null, unknown ones go.

    ``given`` is the value's own type, which tells text from dates, and which struct fields there are.
    """
    meta = meta or {}
    said, format = meta.get("kind"), meta.get("format")
    stamp = isinstance(given, (T.TimestampType, T.TimestampNTZType))
    if said in UNSIGNED:
        return unsigned(c, said)
    if said == "uuid":
        return F.regexp_replace(F.lower(F.hex(uuid_bytes(c))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    if said and said.startswith("fixed:"):
        return fixed(c, int(said[6:]))
    if said and said.startswith("time_") and stamp:
        return time_of_day(c, said[5:])
    if said == "timestamp_nanos" and (stamp or isinstance(given, T.StringType)):
        return timestamp(c, "nanos")
    if isinstance(kind, T.DecimalType):
        return decimal(c, kind.precision, kind.scale)
    if isinstance(kind, T.StringType):
        return text(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return floating(c, kind.simpleString())
    if isinstance(kind, T.DateType) and (format or isinstance(given, T.StringType)):
        return _dated(c, format)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return timestamp(c, said or "micros", isinstance(kind, T.TimestampType))
    if isinstance(kind, T.ArrayType):
        item = given.elementType if isinstance(given, T.ArrayType) else None
        return F.transform(c, lambda x: to_type(x, kind.elementType, meta.get("item"), item))
    if isinstance(kind, T.MapType):
        key, value = (given.keyType, given.valueType) if isinstance(given, T.MapType) else (None, None)
        return F.transform_values(F.transform_keys(c, lambda k, v: to_type(k, kind.keyType, meta.get("key"), key)), lambda k, v: to_type(v, kind.valueType, meta.get("value"), value))
    if isinstance(kind, T.StructType):
        def field(f: T.StructField) -> Column:
            if isinstance(given, T.MapType):
                return to_type(F.try_element_at(c, F.lit(f.name)), f.dataType, f.metadata, given.valueType)
            if isinstance(given, T.StructType) and f.name not in given.names:
                return F.lit(None).cast(f.dataType)
            return to_type(c.getField(f.name), f.dataType, f.metadata, given[f.name].dataType if isinstance(given, T.StructType) else None)

        return F.when(c.isNotNull(), F.struct(*[field(f).alias(f.name) for f in kind]))
    return c.cast(kind)


def _dated(c: Column, format: str | None) -> Column:
    """A date by a pattern or a common shape; text that is neither raises."""
    day = date(c, format)
    return F.when(c.isNull() | day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("not a date: "), c.cast("string"))).cast("date"))
