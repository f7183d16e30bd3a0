"""From what Parquet stores to what a caller wants, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest(c: Column) -> Column:
    """A 32-bit float as the double with its shortest decimal text: 12.3, not 12.300000190734863."""
    return c.cast("string").cast("double")


def uuid_text(c: Column) -> Column:
    """16 bytes as lower-case text with hyphens."""
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def half_float(c: Column) -> Column:
    """Two bytes, low first, as an IEEE 754 half."""
    bits = F.conv(F.hex(F.concat(F.substring(c, 2, 1), F.substring(c, 1, 1))), 16, 10).cast("int")
    sign = F.when(bits >= 32768, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    return (
        F.when(exponent == 31, F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .when(exponent == 0, sign * fraction * F.lit(2.0**-24))
        .otherwise(sign * (1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15))
    )


def time_text(c: Column, unit: str) -> Column:
    """A time of day, as a count of ``millis``, ``micros`` or ``nanos``, as HH:mm:ss and the unit's digits."""
    digits = {"millis": 3, "micros": 6, "nanos": 9}[unit]
    per = 10**digits
    s = F.call_function("div", c.cast("long"), F.lit(per))
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(pad(F.floor(s / 3600), 2), F.lit(":"), pad(F.pmod(F.floor(s / 60), F.lit(60)), 2), F.lit(":"), pad(F.pmod(s, F.lit(60)), 2), F.lit("."), pad(F.pmod(c.cast("long"), F.lit(per)), digits))


def nanos_timestamp(c: Column) -> Column:
    """Nanoseconds since 1970 as a struct: the timestamp in microseconds, and the nanoseconds left."""
    return F.struct(F.timestamp_micros(F.call_function("div", c - F.pmod(c, F.lit(1000)), F.lit(1000))).alias("ts"), F.pmod(c, F.lit(1000)).cast("int").alias("nanos"))


def big_decimal_text(c: Column, scale: int) -> Column:
    """A decimal of any width, as big-endian two's complement bytes, as exact text; 76 digits do not fit Spark's decimals.

    The bytes are folded into limbs of nine decimal digits: no number exceeds a long.
    """
    negative = F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int") >= 128
    byte = lambda i: F.conv(F.substring(F.hex(c), 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.when(negative, 255 - byte(i)).otherwise(byte(i)))
    zero = F.array(*[F.lit(0).cast("long")] * 9)

    def carried(limbs: Column, add: Column, times: int) -> Column:
        start = F.struct(add.cast("long").alias("carry"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda a, x: F.struct(((x * times + a["carry"]) / 1_000_000_000).cast("long").alias("carry"), F.concat(a["out"], F.array(F.pmod(x * times + a["carry"], F.lit(1_000_000_000)))).alias("out"))
        return F.aggregate(limbs, start, step, lambda a: a["out"])

    limbs = F.aggregate(each, zero, lambda a, x: carried(a, x, 256))
    limbs = F.when(negative, carried(limbs, F.lit(1), 1)).otherwise(limbs)
    digits = F.regexp_replace(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), "^0+", "")
    if scale:
        digits = F.when(F.length(digits) <= scale, F.lpad(digits, scale + 1, "0")).otherwise(digits)
        digits = F.concat(F.substring(digits, F.lit(1), F.length(digits) - scale), F.lit("."), F.substring(digits, F.length(digits) - scale + 1, F.lit(scale)))
    else:
        digits = F.when(digits == "", "0").otherwise(digits)
    return F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)
