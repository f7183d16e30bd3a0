"""What violates a schema, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scan import quoted

_REPORT = "array<struct<path: string, reason: string>>"


def _report(ok: Column, path: Column, reason: str) -> Column:
    return F.when(ok, F.expr(f"cast(array() as {_REPORT})")).otherwise(F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason"))))


def _check(c: Column, kind: T.DataType, nullable: bool, path: Column) -> list[Column]:
    out = [] if nullable else [_report(c.isNotNull(), path, "null in a required field")]
    if isinstance(kind, T.StructType):
        out += [x for f in kind for x in _check(c[f.name], f.dataType, f.nullable, F.concat(path, F.lit(f".{f.name}")))]
    elif isinstance(kind, T.ArrayType):
        def item(x: Column, i: Column) -> Column:
            parts = _check(x, kind.elementType, kind.containsNull, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            return F.concat(*parts) if parts else F.expr(f"cast(array() as {_REPORT})")

        if _check(c, kind.elementType, kind.containsNull, path):
            out.append(F.coalesce(F.flatten(F.transform(c, item)), F.expr(f"cast(array() as {_REPORT})")))
    elif isinstance(kind, T.MapType):
        values = F.map_values(c)
        out += _check(values, T.ArrayType(kind.valueType, kind.valueContainsNull), True, F.concat(path, F.lit(".value")))
    return out


def violations(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """(``key``, path, reason) of every null where the schema asks for a value, nested parts included."""
    checks = [x for f in schema for x in _check(F.col(quoted(f.name)), f.dataType, f.nullable, F.lit(f.name))]
    if not checks:
        return df.select(key, F.lit("").alias("path"), F.lit("").alias("reason")).limit(0)
    return df.select(key, F.explode(F.concat(*checks)).alias("_v")).select(key, "_v.path", "_v.reason")
