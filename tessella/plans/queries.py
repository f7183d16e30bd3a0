"""One query for each operator of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError, TessellaError
from ..functions import coerce, decode
from ..operators import batching, validate
from ..sources import annotated, footer, scan, sink
from . import registry
from . import schema as schemas
from .registry import query


def _path(d: str, name: str) -> str:
    return f"{d}/{name}.parquet"


def _shared(spark: SparkSession) -> str:
    """A new path in the folder all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/tessella/{uuid.uuid4().hex}"


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


# ---------------------------------------------------------------- scans


@query("SELECT * FROM lineitem")
def s1_scan_rows(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "lineitem"))


@query("""
SELECT batch_id, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
FROM (SELECT *, CAST((row_number() OVER () - 1) // 1000 AS BIGINT) AS batch_id FROM lineitem) GROUP BY batch_id""")
def s2_scan_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.numbered(scan.read_rows(spark, _path(d, "lineitem")))
    batch = F.floor(F.col("row_index") / 1000).cast("long").alias("batch_id")
    return rows.groupBy("file", batch).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity")).drop("file")


@query("""
SELECT batch_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS ids, string_agg(event_type, ',' ORDER BY place) AS kinds
FROM (SELECT *, row_number() OVER () - 1 AS place, CAST((row_number() OVER () - 1) // 500 AS BIGINT) AS batch_id FROM events) GROUP BY batch_id""")
def s2_column_batches(spark: SparkSession, d: str) -> DataFrame:
    got = scan.batched(spark, _path(d, "events"), 500, ["event_id", "event_type"])
    return got.select("batch_id", F.array_join(got["event_id"].cast("array<string>"), ",").alias("ids"), F.array_join("event_type", ",").alias("kinds"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s3_core_rows(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n FROM (SELECT (row_number() OVER () - 1) // 1024 AS batch_id FROM orders) GROUP BY batch_id")
def s4_core_batches(spark: SparkSession, d: str) -> DataFrame:
    return scan.batched(spark, _path(d, "orders"), 1024, ["o_orderkey"]).select("batch_id", F.size("o_orderkey").cast("long").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_names")
def s5_empty_batches(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "nation")).where(F.lit(False)), path)
    return scan.batched(spark, path, 10).select("batch_id", F.size("n_nationkey").cast("long").alias("n_keys"), F.size("n_name").cast("long").alias("n_names"))


@query("SELECT n_nationkey, n_name FROM nation WHERE false")
def s6_empty_rows(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "nation")).where(F.lit(False)), path)
    return scan.read_rows(spark, path, ["n_nationkey", "n_name"])


_SIZES = [("0", "ArgumentError"), ("-1", "ArgumentError"), ("1.5", "ArgumentError"), ("7", "ok")]


@query(_values(_SIZES, "batch_size, outcome"))
def s7_batch_size(spark: SparkSession, d: str) -> DataFrame:
    def said(v: str) -> str:
        try:
            scan.checked_size(float(v) if "." in v else int(v))
        except TessellaError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(v, said(v)) for v, _ in _SIZES], "batch_size string, outcome string")


@query("SELECT * FROM region")
def s9_stream_source(spark: SparkSession, d: str) -> DataFrame:
    """A file that comes as bytes (also S10 and S11): spooled where executors see it, then scanned."""
    one = spark.read.format("binaryFile").load(_path(d, "region")).first()["content"]
    return scan.read_rows(spark, scan.spooled(spark, bytes(one), _shared(spark)))


class _Pipe(io.RawIOBase):
    """A source that only reads on: it cannot seek."""

    def __init__(self, data: bytes):
        self.held = io.BytesIO(data)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.held.readinto(buffer)


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def s10_pipe_source(spark: SparkSession, d: str) -> DataFrame:
    """A stream that seeks, and one that does not."""
    one = bytes(spark.read.format("binaryFile").load(_path(d, "region")).first()["content"])
    read = lambda source: scan.read_rows(spark, scan.spooled(spark, source, _shared(spark)))
    return read(io.BytesIO(one)).unionByName(read(_Pipe(one)))


@query("SELECT r.n_regionkey, count(*) AS n FROM nation r GROUP BY r.n_regionkey")
def s12_lazy_rows(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "nation"), ["n_regionkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT reader, count(*) AS n, sum(c_custkey) AS keys FROM customer, (VALUES (0), (1), (2), (3)) AS v(reader) GROUP BY reader")
def s13_concurrent_readers(spark: SparkSession, d: str) -> DataFrame:
    df = scan.read_rows(spark, _path(d, "customer"), ["c_custkey"])
    out = None
    for i in range(4):
        one = df.agg(F.count("*").alias("n"), F.sum("c_custkey").cast("decimal(38,0)").alias("keys")).select(F.lit(i).alias("reader"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out.select("reader", "n", F.col("keys").cast("long").alias("keys"))


_BAD = [("empty", "SourceError"), ("missing", "SourceError"), ("text", "SourceError")]


@query(_values(_BAD, "input, outcome"))
def s14_invalid_input(spark: SparkSession, d: str) -> DataFrame:
    def said(kind: str) -> str:
        path = f"{_shared(spark)}.parquet" if kind == "missing" else scan.spooled(spark, b"" if kind == "empty" else b"not parquet at all", _shared(spark))
        try:
            scan.opened(spark, path)
        except SourceError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(k, said(k)) for k, _ in _BAD], "input string, outcome string")


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(9,2)) AS VARCHAR) AS narrow, CAST(CAST(CAST(o_totalprice AS DECIMAL(9,2)) AS DECIMAL(38,10)) AS VARCHAR) AS wide FROM orders")
def s15_decimal_widths(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    o = scan.read_rows(spark, _path(d, "orders"), ["o_orderkey", "o_totalprice"])
    sink.write(o.select("o_orderkey", F.col("o_totalprice").cast("decimal(9,2)").alias("narrow"), F.col("o_totalprice").cast("decimal(9,2)").cast("decimal(38,10)").alias("wide")), path)
    return scan.read_rows(spark, path).select("o_orderkey", F.col("narrow").cast("string").alias("narrow"), F.col("wide").cast("string").alias("wide"))


# ---------------------------------------------------------------- projection


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def p1_project(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "lineitem"), ["l_orderkey", "l_quantity", "nope"])


@query("SELECT CAST(i AS INTEGER) AS position, name FROM (VALUES (0, 'o_orderkey'), (1, 'o_totalprice'), (2, 'o_orderdate')) AS v(i, name)")
def p2_file_order(spark: SparkSession, d: str) -> DataFrame:
    names = scan.read_rows(spark, _path(d, "orders"), ["o_orderdate", "o_orderkey", "o_totalprice"]).columns
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


@query("SELECT count(*) AS n FROM orders")
def p3_unknown_columns(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "orders"), ["nope"]).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer")
def p4_no_columns(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "customer"), []).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey AS \"a.key with. dots\", r_name AS \"日本語 !@#\" FROM region")
def p5_odd_names(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "region")).select(F.col("r_regionkey").alias("a.key with. dots"), F.col("r_name").alias("日本語 !@#")), path)
    return scan.read_rows(spark, path, ["日本語 !@#", "a.key with. dots"])


@query("SELECT n_nationkey, n_nationkey + 7 AS c7, n_nationkey + 999 AS c999 FROM nation")
def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "nation")).select("n_nationkey", *[(F.col("n_nationkey") + i).alias(f"c{i}") for i in range(1000)]), path)
    return scan.read_rows(spark, path, ["c999", "c7", "n_nationkey"])


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS n_comment FROM nation UNION ALL SELECT n_nationkey + 100, n_name, 'new' FROM nation")
def p8_evolution(spark: SparkSession, d: str) -> DataFrame:
    path, n = _shared(spark), scan.read_rows(spark, _path(d, "nation"), ["n_nationkey", "n_name"])
    sink.write(n, f"{path}/v=1")
    sink.write(n.select((F.col("n_nationkey") + 100).alias("n_nationkey"), "n_name", F.lit("new").alias("n_comment")), f"{path}/v=2")
    schema = T.StructType([*n.schema.fields, T.StructField("n_comment", T.StringType())])
    return scan.read_rows(spark, path, ["n_nationkey", "n_name", "n_comment"], schema)


# ---------------------------------------------------------------- decoders


@query("SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS first, l_shipdate FROM lineitem")
def d1_plain_types(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate"]).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 1).alias("first"), "l_shipdate")


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(CAST(embedding[i] AS VARCHAR) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def d4_float_lists(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "embeddings"), ["vec_id", "embedding"])
    return e.select("vec_id", F.posexplode("embedding").alias("i", "f")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), decode.shortest(F.col("f")).alias("x"))


def _stored_types(spark: SparkSession, d: str, **options: Any) -> str:
    """A file by another writer with columns of every annotated type, made from the 25 nations."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = sorted(r[0] for r in scan.read_rows(spark, _path(d, "nation"), ["n_nationkey"]).collect())
    ids = pa.array([hashlib.md5(str(k).encode()).digest() for k in keys], pa.binary(16))
    uuids = pa.ExtensionArray.from_storage(pa.uuid(), ids)
    each = lambda f, kind: pa.array([f(k) for k in keys], kind)
    table = pa.table(
        {
            "k": pa.array(keys, pa.int64()),
            "half": pa.array([np.float16(k / 4 - 2) for k in keys], pa.float16()),
            "id": uuids,
            "ms": each(lambda k: k * 3_421_001, pa.time32("ms")),
            "us": each(lambda k: k * 3_421_000_001, pa.time64("us")),
            "ns": each(lambda k: k * 3_421_000_000_001, pa.time64("ns")),
            "stamp": each(lambda k: k * 86_400_000_001_003, pa.timestamp("ns")),
            "wide": each(lambda k: Decimal(f"{'-' if k % 2 else ''}{k}{'0' * 40}.25"), pa.decimal256(60, 2)),
            "u8": each(lambda k: 255 - k, pa.uint8()),
            "u16": each(lambda k: 65_535 - k, pa.uint16()),
            "u32": each(lambda k: 2**32 - 1 - k, pa.uint32()),
            "u64": each(lambda k: 2**64 - 1 - k, pa.uint64()),
            "bytes": each(lambda k: bytes([k, 255 - k]) if k % 5 else None, pa.binary()),
            "fixed": each(lambda k: bytes([k] * 3), pa.binary(3)),
            "day": each(lambda k: k * 100, pa.date32()),
            "moment": each(lambda k: k * 86_400_000, pa.date64()),
            "ids": pa.ListArray.from_arrays(pa.array(range(len(keys) + 1), pa.int32()), uuids),
        }
    )
    held = io.BytesIO()
    pq.write_table(table, held, version="2.6", **options)
    return scan.spooled(spark, held.getvalue(), _shared(spark))


def _clock(per: int, digits: int) -> str:
    """SQL for the time of day of the file above, which has ``per`` units a second."""
    v = f"(n_nationkey::HUGEINT * {3_421 * per + 1})"
    pad = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
    return f"{pad(f'{v} // {3600 * per}', 2)} || ':' || {pad(f'{v} // {60 * per} % 60', 2)} || ':' || {pad(f'{v} // {per} % 60', 2)} || '.' || {pad(f'{v} % {per}', digits)}"


_UUID_SQL = "regexp_replace(md5(CAST(n_nationkey AS VARCHAR)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(255 - n_nationkey AS SMALLINT) AS u8, CAST(65535 - n_nationkey AS INTEGER) AS u16, CAST(4294967295 - n_nationkey AS BIGINT) AS u32, CAST(18446744073709551615 - n_nationkey::HUGEINT AS VARCHAR) AS u64 FROM nation")
def d2_unsigned(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "u8", "u16", "u32", "u64"]).withColumn("u64", F.col("u64").cast("string"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey / 4.0 - 2 AS DOUBLE) AS half FROM nation")
def d3_half_floats(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "half"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 5 <> 0 THEN upper(printf('%02x%02x', n_nationkey, 255 - n_nationkey)) END AS bytes FROM nation")
def d7_binary(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "bytes"]).withColumn("bytes", F.hex("bytes"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, upper(repeat(printf('%02x', n_nationkey), 3)) AS fixed FROM nation")
def d8_fixed_binary(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "fixed"]).withColumn("fixed", F.hex("fixed"))


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS k, {_UUID_SQL} AS id, {_UUID_SQL} AS item FROM nation")
def d9_uuid(spark: SparkSession, d: str) -> DataFrame:
    """A column of UUIDs, and lists of them."""
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "id", "ids"]).select("k", "id", F.col("ids")[0].alias("item"))


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS k, {_UUID_SQL} AS id FROM nation")
def s16_logical_types(spark: SparkSession, d: str) -> DataFrame:
    """Without the writer's own schema in the footer the logical type alone says UUID."""
    return annotated.read_annotated(spark, _stored_types(spark, d, store_schema=False), ["k", "id"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(DATE '1970-01-01' + n_nationkey * 100 AS VARCHAR) AS day FROM nation")
def d10_dates(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "day"]).withColumn("day", F.col("day").cast("string"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(DATE '1970-01-01' + n_nationkey AS VARCHAR) AS moment FROM nation")
def d11_date64(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "moment"]).withColumn("moment", F.col("moment").cast("string"))


@query("SELECT event_id, epoch_us(ts) AS micros, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def d12_timestamps(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "events"), ["event_id", "ts"])
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.to_date("ts").cast("string").alias("day"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * 86400000001003 // 1000 AS BIGINT) AS micros, CAST(n_nationkey * 86400000001003 % 1000 AS INTEGER) AS nanos FROM nation")
def d13_nanos(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "stamp"]).select("k", F.unix_micros("stamp.ts").alias("micros"), "stamp.nanos")


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS k, {_clock(1000, 3)} AS ms, {_clock(10**6, 6)} AS us, {_clock(10**9, 9)} AS ns FROM nation")
def d14_time_of_day(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "ms", "us", "ns"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 2 = 1 THEN '-' ELSE '' END || CASE WHEN n_nationkey = 0 THEN '0' ELSE n_nationkey || repeat('0', 40) END || '.25' AS wide FROM nation")
def d16_wide_decimals(spark: SparkSession, d: str) -> DataFrame:
    return annotated.read_annotated(spark, _stored_types(spark, d), ["k", "wide"])


_UNSUPPORTED = [("a duration", "SourceError"), ("a number", "ok")]


@query(_values(_UNSUPPORTED, "input, outcome"))
def d21_unsupported(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.parquet as pq

    def said(kind: pa.DataType) -> str:
        held = io.BytesIO()
        pq.write_table(pa.table({"x": pa.array([1], kind)}), held)
        try:
            annotated.read_annotated(spark, scan.spooled(spark, held.getvalue(), _shared(spark))).collect()
        except TessellaError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([("a duration", said(pa.duration("s"))), ("a number", said(pa.int64()))], "input string, outcome string")


@query("SELECT n_nationkey, 'k' || n_regionkey AS key, n_name AS value, CAST(n_regionkey AS INTEGER) AS inner_id FROM nation")
def d18_nested(spark: SparkSession, d: str) -> DataFrame:
    """Maps and structs (D17 to D19) written and read back."""
    path, n = _shared(spark), scan.read_rows(spark, _path(d, "nation"))
    sink.write(n.select("n_nationkey", F.create_map(F.concat(F.lit("k"), F.col("n_regionkey").cast("string")), "n_name").alias("m"), F.struct(F.struct(F.col("n_regionkey").alias("id")).alias("inner")).alias("s")), path)
    back = scan.read_rows(spark, path)
    return back.select("n_nationkey", F.explode("m").alias("key", "value"), F.col("s.inner.id").cast("int").alias("inner_id"))


@query("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS as_hash, r_regionkey || ',' || r_name AS as_array FROM region")
def d22_row_shapes(spark: SparkSession, d: str) -> DataFrame:
    r = scan.read_rows(spark, _path(d, "region"), ["r_regionkey", "r_name"])
    return r.select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("as_hash"), F.concat_ws(",", F.col("r_regionkey").cast("string"), "r_name").alias("as_array"))


# ---------------------------------------------------------------- coercions


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS TINYINT) AS i8, CAST(l_linenumber AS SMALLINT) AS i16, CAST(l_partkey AS INTEGER) AS i32, l_orderkey + 0 AS i64 FROM lineitem")
def c2_integers(spark: SparkSession, d: str) -> DataFrame:
    li = scan.read_rows(spark, _path(d, "lineitem"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c).cast("long").cast("string"), F.lit(" "))
    return li.select("l_orderkey", "l_linenumber", coerce.integer(spaced("l_quantity"), "int8").alias("i8"), coerce.integer(spaced("l_linenumber"), "int16").alias("i16"), coerce.integer(spaced("l_partkey"), "int32").alias("i32"), coerce.integer(spaced("l_orderkey"), "int64").alias("i64"))


@query("SELECT c_custkey, CAST(c_custkey % 256 AS SMALLINT) AS u8, CAST(c_custkey % 65536 AS INTEGER) AS u16, c_custkey * 1000 AS u32, CAST(c_custkey * 100000000000 AS VARCHAR) AS u64 FROM customer")
def c3_unsigned(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return scan.read_rows(spark, _path(d, "customer"), ["c_custkey"]).select("c_custkey", coerce.unsigned(k % 256, "uint8").alias("u8"), coerce.unsigned(k % 65536, "uint16").alias("u16"), coerce.unsigned(k * 1000, "uint32").alias("u32"), coerce.unsigned(k * 100000000000, "uint64").cast("string").alias("u64"))


@query("SELECT doc_id, text, CAST(n_chars AS VARCHAR) AS n, n_chars > 1000 AS long_one, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def c5_text(spark: SparkSession, d: str) -> DataFrame:
    """Text, binary and boolean."""
    t = scan.read_rows(spark, _path(d, "documents"))
    return t.select("doc_id", coerce.text(F.col("text")).alias("text"), coerce.text(F.col("n_chars")).alias("n"), coerce.boolean(F.when(F.col("n_chars") > 1000, "true").otherwise("false")).alias("long_one"), F.octet_length(coerce.binary(F.col("text"))).cast("long").alias("bytes"))


@query("SELECT o_orderkey, upper(md5(CAST(o_orderkey AS VARCHAR))) AS bytes FROM orders")
def c8_uuid_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Hyphenated, bare and upper-case UUIDs."""
    bare = F.md5(F.col("o_orderkey").cast("string"))
    some = F.when(F.col("o_orderkey") % 3 == 0, F.upper(bare)).when(F.col("o_orderkey") % 3 == 1, bare).otherwise(F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))
    return scan.read_rows(spark, _path(d, "orders"), ["o_orderkey"]).select("o_orderkey", F.hex(coerce.fixed(coerce.uuid_bytes(some), 16)).alias("bytes"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS b, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS c FROM orders")
def c9_dates(spark: SparkSession, d: str) -> DataFrame:
    """By pattern and by shape."""
    o = scan.read_rows(spark, _path(d, "orders"), ["o_orderkey", "o_orderdate"])
    f = lambda p: F.date_format("o_orderdate", p)
    return o.select("o_orderkey", *[c.cast("string").alias(a) for c, a in ((coerce.date(f("yyyy/MM/dd"), "%Y/%m/%d"), "a"), (coerce.date(f("MMM dd, yyyy"), "%b %d, %Y"), "b"), (coerce.date(f("dd/MM/yyyy")), "c"))])


@query("SELECT event_id, CAST(epoch_us(ts) % 86400000000 // 1000 AS INTEGER) AS ms, epoch_us(ts) % 86400000000 AS us, epoch_us(ts) % 86400000000 * 1000 AS ns FROM events")
def c11_times(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "events"), ["event_id", "ts"])
    return e.select("event_id", *[coerce.time_of_day(F.col("ts"), u).alias(a) for u, a in (("millis", "ms"), ("micros", "us"), ("nanos", "ns"))])


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS s, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns FROM events")
def c12_timestamps(spark: SparkSession, d: str) -> DataFrame:
    e, ts = scan.read_rows(spark, _path(d, "events"), ["event_id", "ts"]), F.col("ts").cast("timestamp")
    return e.select("event_id", *[F.unix_micros(coerce.timestamp(ts, u)).alias(a) for u, a in (("second", "s"), ("millis", "ms"), ("micros", "us"))], coerce.timestamp(ts, "nanos").alias("ns"))


@query("SELECT event_id, epoch_us(ts) - CASE event_id % 3 WHEN 0 THEN 32400000000 WHEN 1 THEN -18000000000 ELSE 0 END AS us, CASE event_id % 3 WHEN 0 THEN '+09:00' WHEN 1 THEN '-05:00' ELSE '+00:00' END AS zone FROM events")
def c13_iso_text(spark: SparkSession, d: str) -> DataFrame:
    """ISO 8601 with offsets, in UTC."""
    e, at = scan.read_rows(spark, _path(d, "events"), ["event_id", "ts"]), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(F.col("event_id") % 3 == 0, "+09:00").when(F.col("event_id") % 3 == 1, "-05:00").otherwise("Z")
    return e.select("event_id", F.unix_micros(coerce.timestamp(F.concat(at, zone))).alias("us"), coerce.offset(F.concat(at, zone)).alias("zone"))


@query("SELECT o_orderkey, CAST(CAST(trunc(CAST(-o_totalprice AS DECIMAL(18,2)) * 10) / 10 AS DECIMAL(18,1)) AS VARCHAR) AS one, CAST(CAST(trunc(CAST(-o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,0)) AS VARCHAR) AS none FROM orders")
def c16_decimals(spark: SparkSession, d: str) -> DataFrame:
    """Cut toward zero, not rounded (C16, C17 to 38 digits)."""
    o, s = scan.read_rows(spark, _path(d, "orders"), ["o_orderkey", "o_totalprice"]), (-F.col("o_totalprice")).cast("decimal(18,2)").cast("string")
    return o.select("o_orderkey", coerce.decimal(s, 18, 1).cast("string").alias("one"), coerce.decimal(s, 18, 0).cast("string").alias("none"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS VARCHAR) AS FLOAT)::DOUBLE AS f32, c_acctbal AS f64 FROM customer")
def c4_floats(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))
    return scan.read_rows(spark, _path(d, "customer")).select("c_custkey", coerce.floating(text, "float").cast("double").alias("f32"), coerce.floating(text).alias("f64"))


@query("SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS item, CAST(n_nationkey AS SMALLINT) AS small, upper(substr(n_name, 1, 1)) AS key, n_name AS street, NULL::VARCHAR AS zip, n_name AS from_map FROM nation")
def c20_nested(spark: SparkSession, d: str) -> DataFrame:
    """Lists, maps and structs by their parts, which keep their kinds; a missing struct field is null, an unknown one goes."""
    n = scan.read_rows(spark, _path(d, "nation"))
    named = F.struct(F.col("n_name").alias("street"), F.lit("x").alias("extra"))
    raw = n.select("n_nationkey", F.array(F.col("n_regionkey").cast("string")).alias("l"), F.array(F.col("n_nationkey").cast("string")).alias("u"), F.create_map(F.upper(F.substring("n_name", 1, 1)), F.lit("1")).alias("m"), named.alias("s"), F.create_map(F.lit("street"), "n_name").alias("h"))
    place = {"fields": [{"name": "street", "type": "string"}, {"name": "zip", "type": "string"}]}
    want = schemas.define(lambda b: b.field("n_nationkey", "int32").field("l", "list<int64>").field("u", "list", item={"type": "uint8"}).field("m", "map<string,int32>").field("s", "struct", **place).field("h", "struct", **place))
    out = sink.conformed(raw, want)
    return out.select("n_nationkey", F.col("l")[0].alias("item"), F.col("u")[0].alias("small"), F.map_keys("m")[0].alias("key"), "s.street", "s.zip", F.col("h.street").alias("from_map"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def c10_free_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written from text without a pattern."""
    o, path = scan.read_rows(spark, _path(d, "orders"), ["o_orderkey", "o_orderdate"]), _shared(spark)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    sink.write(o.select("o_orderkey", text.alias("day")), path, schema=schemas.normalise([{"o_orderkey": "int64"}, {"day": "date32"}]))
    return scan.read_rows(spark, path).withColumn("day", F.col("day").cast("string"))


_KINDS = [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "boolean"), ("e", "array<bigint>"), ("f", "map<string,bigint>"), ("g", "decimal(38,18)")]


@query(_values(_KINDS, "name, kind"))
def c21_inference(spark: SparkSession, d: str) -> DataFrame:
    from decimal import Decimal

    df = spark.createDataFrame([{"a": 1, "b": 1.5, "c": "x", "d": True, "e": [1], "f": {"k": 1}, "g": Decimal("1.5")}])
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, kind string")


# ---------------------------------------------------------------- sinks


def _register_codecs() -> None:
    for name in ("uncompressed", "snappy", "gzip", "lz4", "zstd"):
        def f(spark: SparkSession, d: str, codec: str = name) -> DataFrame:
            path = _shared(spark)
            sink.write(scan.read_rows(spark, _path(d, "part")), path, codec.upper())
            return scan.read_rows(spark, path)

        f.__name__ = f"k6_codec_{name}"
        query("SELECT * FROM part")(f)


_register_codecs()


@query("SELECT s_suppkey, s_name, CAST(s_acctbal AS VARCHAR) AS balance FROM (SELECT s_suppkey, s_name, CAST(trunc(CAST(s_acctbal AS DECIMAL(12,2)) * 10) / 10 AS DECIMAL(12,1)) AS s_acctbal FROM supplier)")
def k1_write_rows(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    want = schemas.define(lambda b: b.field("s_suppkey", "int64", False).field("s_name", "string").field("s_acctbal", "decimal", precision=12, scale=1))
    sink.write(scan.read_rows(spark, _path(d, "supplier")), path, schema=want)
    return scan.read_rows(spark, path).select("s_suppkey", "s_name", F.col("s_acctbal").cast("string").alias("balance"))


@query("SELECT event_id, event_type FROM events")
def k2_write_columns(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(sink.zipped(scan.batched(spark, _path(d, "events"), 300, ["event_id", "event_type"]), ["event_id", "event_type"]).drop("_at"), path)
    return scan.read_rows(spark, path)


@query("SELECT r_name, r_regionkey FROM region")
def k4_columns_by_name(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "region")), path, schema=schemas.normalise([{"r_name": "string"}, {"r_regionkey": "int32"}]))
    return scan.read_rows(spark, path)


@query("SELECT * FROM nation")
def k5_single_file(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_shared(spark)}/one.parquet"
    sink.write_file(scan.read_rows(spark, _path(d, "nation")), path)
    return scan.read_rows(spark, path)


@query("SELECT * FROM nation")
def k5_stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """Into an open stream, and from its bytes again."""
    held = io.BytesIO()
    sink.write_stream(scan.read_rows(spark, _path(d, "nation")), held, _shared(spark), compression="gzip")
    return scan.read_rows(spark, scan.spooled(spark, held.getvalue(), _shared(spark)))


_WRITER = [("closed", "25 rows"), ("open", "nothing readable"), ("used after close", "TessellaError"), ("failed", "nothing readable")]


@query(_values(_WRITER, "state, outcome"))
def k8_writer(spark: SparkSession, d: str) -> DataFrame:
    """What is readable while a writer is open, once it is closed, and after an error."""
    n = scan.read_rows(spark, _path(d, "nation"))

    def seen(path: str) -> str:
        try:
            return f"{scan.opened(spark, path).count()} rows"
        except SourceError:
            return "nothing readable"

    path, other, out = _shared(spark), _shared(spark), {}
    w = sink.Writer(spark, path, compression="zstd").write(n.where("n_nationkey < 10"))
    out["open"] = seen(path)
    w.write(n.where("n_nationkey >= 10")).close()
    out["closed"] = seen(path)
    try:
        w.write(n)
    except TessellaError as e:
        out["used after close"] = type(e).__name__
    try:
        with sink.Writer(spark, other) as w:
            w.write(n)
            raise ValueError("the source failed")
    except ValueError:
        out["failed"] = seen(other)
    return spark.createDataFrame(sorted(out.items()), "state string, outcome string")


_FAILING = [("a source that fails midway", "nothing readable"), ("one that does not", "25 rows")]


@query(_values(_FAILING, "source, left_behind"))
def k9_failed_write(spark: SparkSession, d: str) -> DataFrame:
    n = scan.read_rows(spark, _path(d, "nation")).repartition(3)

    def left(df: DataFrame) -> str:
        path = _shared(spark)
        try:
            sink.write(df, path)
        except TessellaError:
            pass
        try:
            return f"{scan.opened(spark, path).count()} rows"
        except SourceError:
            return "nothing readable"

    failing = n.withColumn("n_name", F.when(F.col("n_nationkey") < 20, F.col("n_name")).otherwise(F.raise_error(F.lit("the source failed")).cast("string")))
    return spark.createDataFrame([("a source that fails midway", left(failing)), ("one that does not", left(n))], "source string, left_behind string")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BOOLEAN) AS plain FROM part")
def k7_writer_properties(spark: SparkSession, d: str) -> DataFrame:
    path = _shared(spark)
    sink.write(scan.read_rows(spark, _path(d, "part"), ["p_partkey", "p_brand"]).coalesce(1), path, row_group_bytes=1 << 20, dictionary=False, version="v1")
    chunks = footer.footers(spark, f"{path}/*.parquet", "chunks").where("column_path = 'p_brand'")
    return chunks.agg(F.sum("num_values").alias("n"), F.min(~F.array_contains("encodings", "PLAIN_DICTIONARY")).alias("plain"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS f0, n_name AS f1 FROM nation")
def k10_no_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a schema, written as strings f0, f1, ... and read back; the rows are the 25 nations."""
    path = _shared(spark)
    rows = [tuple(r) for r in scan.read_rows(spark, _path(d, "nation"), ["n_nationkey", "n_name"]).collect()]
    sink.write(sink.rows_frame(spark, rows), path)
    return scan.read_rows(spark, path)


_RAGGED = [("even", "ok"), ("ragged", "CoercionError")]


@query(_values(_RAGGED, "input, outcome"))
def k11_ragged(spark: SparkSession, d: str) -> DataFrame:
    from ..errors import explained

    def said(kind: str) -> str:
        b = spark.createDataFrame([([1, 2], ["a"] if kind == "ragged" else ["a", "b"])], "x array<int>, y array<string>")
        try:
            with explained("zipping"):
                sink.zipped(b, ["x", "y"]).collect()
        except TessellaError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(k, said(k)) for k, _ in _RAGGED], "input string, outcome string")


# ---------------------------------------------------------------- metadata

_SF = registry.FOLDER


@query(f"SELECT num_rows, created_by, num_row_groups FROM parquet_file_metadata('{_SF}/lineitem.parquet')")
def m2_file_metadata(spark: SparkSession, d: str) -> DataFrame:
    return footer.footers(spark, _path(d, "lineitem"), "file").select("num_rows", "created_by", "num_row_groups")


@query(f"SELECT name, type AS physical_type, repetition_type AS repetition FROM parquet_schema('{_SF}/orders.parquet') WHERE num_children IS NULL")
def m3_fields(spark: SparkSession, d: str) -> DataFrame:
    return footer.footers(spark, _path(d, "orders"), "fields").select("name", "physical_type", "repetition")


@query(f"SELECT DISTINCT row_group_id AS ordinal, row_group_num_rows AS num_rows, row_group_num_columns AS num_columns, row_group_bytes AS total_byte_size FROM parquet_metadata('{_SF}/lineitem.parquet')")
def m5_row_groups(spark: SparkSession, d: str) -> DataFrame:
    return footer.footers(spark, _path(d, "lineitem"), "row_groups").select("ordinal", "num_rows", "num_columns", "total_byte_size")


@query(f"SELECT row_group_id AS row_group, path_in_schema AS column_path, compression, num_values, total_compressed_size, total_uncompressed_size, data_page_offset, dictionary_page_offset, stats_null_count AS null_count FROM parquet_metadata('{_SF}/lineitem.parquet')")
def m6_column_chunks(spark: SparkSession, d: str) -> DataFrame:
    return footer.footers(spark, _path(d, "lineitem"), "chunks").select("row_group", "column_path", "compression", "num_values", "total_compressed_size", "total_uncompressed_size", "data_page_offset", "dictionary_page_offset", "null_count")


@query(f"SELECT row_group_id AS row_group, path_in_schema AS column_path, file_offset FROM parquet_metadata('{_SF}/orders.parquet')")
def m7_chunk_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the footer says that chunks lie (M6, M7)."""
    return footer.footers(spark, _path(d, "orders"), "chunks").select("row_group", "column_path", "file_offset")


@query(f"SELECT row_group_id AS row_group, path_in_schema AS column_path, trim(e) AS encoding FROM (SELECT row_group_id, path_in_schema, unnest(string_split(encodings, ',')) AS e FROM parquet_metadata('{_SF}/customer.parquet'))")
def m8_encodings(spark: SparkSession, d: str) -> DataFrame:
    return footer.footers(spark, _path(d, "customer"), "chunks").select("row_group", "column_path", F.explode("encodings").alias("encoding"))


# ---------------------------------------------------------------- schemas


def _people() -> T.StructType:
    return schemas.define(lambda b: b.field("id", "int64", False).field("name", "string").field("address", "struct", fields=lambda a: a.field("street", "string").field("zip", "int32")).field("tags", "list", item="string").field("scores", "map", key="string", value="double").field("price", "decimal", precision=9, scale=2).field("at", "timestamp_micros"))


_PATHS = [("address", "struct"), ("address.street", "string"), ("address.zip", "int32"), ("at", "timestamp_micros"), ("id", "int64"), ("name", "string"), ("price", "decimal(9,2)"), ("scores", "map"), ("scores.key", "string"), ("scores.value", "double"), ("tags", "list"), ("tags.item", "string")]


@query(_values(_PATHS, "path, type"))
def h12_field_paths(spark: SparkSession, d: str) -> DataFrame:
    """The builder (H1, H4, H14) and the inspector."""
    return spark.createDataFrame([(p, schemas.type_name(k)) for p, k, _ in schemas.walk(_people())], "path string, type string")


_NAMES = [("list<map<string,list<int32>>>", "array<map<string,array<int>>>"), ("decimal(9,2)", "decimal(9,2)"), ("decimal", "decimal(38,0)"), ("uint32", "bigint"), ("fixed_len_byte_array(16)", "binary"), ("timestamp", "timestamp"), ("map<string,decimal(9,2)>", "map<string,decimal(9,2)>"), ("time_micros", "bigint")]


@query(_values(_NAMES, "name, kind"))
def h2_type_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, schemas.parse_type(n)[0].simpleString()) for n, _ in _NAMES], "name string, kind string")


_FORMS = [("fields", "timestamp_ntz"), ("has_timezone", "timestamp"), ("item", "array<timestamp>"), ("legacy", "timestamp"), ("named", "timestamp_ntz"), ("none", "string"), ("unknown key", "SchemaError")]


@query(_values(_FORMS, "form, kind"))
def h6_notations(spark: SparkSession, d: str) -> DataFrame:
    """Every notation (H4 to H6), and what a timestamp is in it."""
    forms = {
        "legacy": [{"x": "timestamp"}],
        "named": [{"name": "x", "type": "timestamp"}],
        "fields": {"fields": [{"name": "x", "type": "timestamp"}]},
        "has_timezone": [{"name": "x", "type": "timestamp", "has_timezone": True}],
        "item": [{"name": "x", "type": "list", "item": {"type": "timestamp", "has_timezone": True}}],
        "unknown key": [{"name": "x", "type": "int32", "zone": True}],
        "none": None,
    }

    def said(form) -> str:
        try:
            return schemas.normalise(form, 1)[0].dataType.simpleString()
        except TessellaError as e:
            return type(e).__name__

    return spark.createDataFrame([(k, said(v)) for k, v in sorted(forms.items())], "form string, kind string")


_EVERY = [*sorted(schemas.NAMES), "decimal(9,2)", "fixed_len_byte_array(5)", "list<uint8>", "list<list<timestamp_second>>", "map<string,time_nanos>", "uuid"]


@query(_values([(n, "the same") for n in _EVERY], "name, back"))
def h7_to_dict(spark: SparkSession, d: str) -> DataFrame:
    """Every type's name to a schema, its dictionary, and the schema again."""

    def back(name: str) -> str:
        parts = {"type": "binary", "format": "uuid"} if name == "uuid" else {"type": name}
        s = schemas.normalise([{"name": "x", "nullable": False, **parts}, {"name": "s", "type": "struct", "fields": [{"name": "l", "type": "list", "item": parts}]}])
        again = schemas.normalise({"fields": schemas.to_dict(s)["fields"]})
        same = again == s and [f.metadata for f in again] == [f.metadata for f in s] and again["s"].dataType["l"].metadata == s["s"].dataType["l"].metadata
        return "the same" if same else schemas.to_dict(s)["fields"][0]["type"]

    return spark.createDataFrame([(n, back(n)) for n in _EVERY], "name string, back string")


_FOUND = [("address.zip", "int"), ("scores.value", "double"), ("tags.item", "string"), ("nope.x", "nothing"), ("", "12 fields")]


@query(_values(_FOUND, "path, kind"))
def h11_find(spark: SparkSession, d: str) -> DataFrame:
    """Types by dotted path, and the number of all fields."""
    s = _people()
    kinds = [(p, f"{schemas.field_count(s)} fields" if not p else k.simpleString() if (k := schemas.find(s, p)) is not None else "nothing") for p, _ in _FOUND]
    return spark.createDataFrame(kinds, "path string, kind string")


_WRONG = [("duplicate", "SchemaError"), ("empty struct", "SchemaError"), ("list without item", "SchemaError"), ("negative scale", "SchemaError"), ("unknown type", "SchemaError")]


@query(_values(_WRONG, "fault, outcome"))
def h9_faults(spark: SparkSession, d: str) -> DataFrame:
    tries = {"duplicate": lambda b: b.field("a", "int32").field("a", "int32"), "empty struct": lambda b: b.field("a", "struct"), "list without item": lambda b: b.field("a", "list"), "negative scale": lambda b: b.field("a", "decimal", precision=5, scale=-2), "unknown type": lambda b: b.field("a", "int128")}

    def said(fill) -> str:
        try:
            schemas.define(fill)
        except TessellaError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(k, said(f)) for k, f in tries.items()], "fault string, outcome string")


# ---------------------------------------------------------------- validation


@query("""
SELECT o_orderkey, 'status' AS path, 'null in a required field' AS reason FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'items[1]', 'null in a required field' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 's.day', 'null in a required field' FROM orders WHERE o_orderkey % 7 = 0""")
def v7_violations(spark: SparkSession, d: str) -> DataFrame:
    """V2 to V5 as a report."""
    o = scan.read_rows(spark, _path(d, "orders"))
    df = o.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.array(F.lit(1), F.when(F.col("o_orderkey") % 5 != 0, F.lit(2))).alias("items"), F.struct(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("day")).alias("s"))
    want = T.StructType([T.StructField("status", T.StringType(), False), T.StructField("items", T.ArrayType(T.IntegerType(), False), False), T.StructField("s", T.StructType([T.StructField("day", T.TimestampNTZType(), False)]), False)])
    return validate.violations(df, want, "o_orderkey")


_ARGS = [("compression=brotlix", "ArgumentError"), ("compression=SNAPPY", "ok"), ("result_type=hash", "ok"), ("result_type=list", "ArgumentError"), ("row too wide", "SchemaError")]


@query(_values(_ARGS, "argument, outcome"))
def v6_arguments(spark: SparkSession, d: str) -> DataFrame:
    """V1 and V6."""
    tries = [lambda: sink.codec("brotlix"), lambda: sink.codec("SNAPPY"), lambda: scan.result_type("hash"), lambda: scan.result_type("list"), lambda: sink.rows_frame(spark, [(1, 2, 3)], [{"a": "int32"}])]

    def said(f) -> str:
        try:
            f()
        except TessellaError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(k, said(f)) for (k, _), f in zip(_ARGS, tries, strict=True)], "argument string, outcome string")


# ---------------------------------------------------------------- sizes and batches

_DOC_SIZE = "8 + octet_length(encode(text)) + 24 + octet_length(encode(lang)) + 24 + octet_length(encode(source)) + 24 + 8"


@query(f"SELECT doc_id, CAST({_DOC_SIZE} AS BIGINT) AS bytes FROM documents")
def z2_row_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Z1 and Z2."""
    t = scan.read_rows(spark, _path(d, "documents"))
    return t.select("doc_id", batching.row_size(t.schema).alias("bytes"))


@query("SELECT vec_id, CAST(8 + 24 + 4 * len(embedding) + 4 AS BIGINT) AS adapter, CAST(8 + 24 + 4 * len(embedding) + 4 AS BIGINT) AS core FROM embeddings")
def z3_nested_sizes(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "embeddings"))
    return e.select("vec_id", batching.row_size(e.schema).alias("adapter"), batching.row_size(e.schema, core=True).alias("core"))


@query(f"""
SELECT doc_id, n, CAST(CASE WHEN n < 10 THEN 100 ELSE greatest(10, 800000 // mean) END AS BIGINT) AS batch_size, CAST(recent AS BIGINT) AS recent_mean FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, CAST(floor(avg(bytes) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS mean,
         floor(avg(bytes) OVER (ORDER BY doc_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS recent
  FROM (SELECT doc_id, {_DOC_SIZE} AS bytes FROM documents ORDER BY doc_id LIMIT 100))""")
def z4_planner(spark: SparkSession, d: str) -> DataFrame:
    """Z4 over the rows of the sample, and the means that Z5 compares."""
    t = scan.read_rows(spark, _path(d, "documents"))
    sized = t.select("doc_id", batching.row_size(t.schema).alias("bytes"))
    return batching.plan(sized, "doc_id", "bytes", threshold=1_000_000).where("n <= 100").select("doc_id", "n", "batch_size", "recent_mean")


@query(f"""
WITH sized AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, {_DOC_SIZE} AS bytes FROM documents),
means AS (SELECT doc_id, n, CAST(floor(avg(bytes) FILTER (WHERE n <= 100) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS mean,
                 CAST(floor(avg(bytes) OVER (ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS BIGINT) AS recent FROM sized),
steps AS (SELECT doc_id, n, recent, CASE WHEN n BETWEEN 10 AND 100 THEN greatest(10, 800000 // mean)
                 WHEN n > 100 AND n % 50 = 0 AND (recent > mean * 2 OR recent < mean // 2) THEN greatest(10, 800000 // recent) END AS new FROM means)
SELECT doc_id, n, CAST(coalesce(last_value(new IGNORE NULLS) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING), 100) AS BIGINT) AS batch_size, recent AS recent_mean FROM steps""")
def z5_drift(spark: SparkSession, d: str) -> DataFrame:
    """Z4 and Z5 over every row: the batch size follows the recent rows where they drift from the sample."""
    t = scan.read_rows(spark, _path(d, "documents"))
    sized = t.select("doc_id", batching.row_size(t.schema).alias("bytes"))
    return batching.plan(sized, "doc_id", "bytes", threshold=1_000_000).select("doc_id", "n", "batch_size", "recent_mean")


@query("SELECT CAST((rn - 1) // 50 AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def z6_flushes(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "events"))
    sized = scan.numbered(e).select("event_id", batching.row_size(e.select("event_id", "value").schema).alias("bytes"), "file", "row_index")
    return batching.flushes(sized, "event_id", "bytes", 50, 1 << 26, "file", "row_index").groupBy("part", "batch").agg(F.count("*").alias("n"), F.min("at").alias("first_id")).drop("part")


@query(f"SELECT greatest(10, 104857600 // CAST(floor(avg({_DOC_SIZE})) AS BIGINT)) AS batch_size FROM documents")
def z7_core_batch(spark: SparkSession, d: str) -> DataFrame:
    t = scan.read_rows(spark, _path(d, "documents"))
    return t.agg(F.floor(F.avg(batching.row_size(t.schema))).alias("mean")).select(batching.core_batch_size(F.col("mean")).alias("batch_size"))


@query("SELECT count(DISTINCT event_type) AS misses, count(event_type) - count(DISTINCT event_type) AS hits FROM events")
def x1_string_cache(spark: SparkSession, d: str) -> DataFrame:
    e = scan.read_rows(spark, _path(d, "events"), ["event_type"])
    return e.agg(F.count_distinct("event_type").alias("misses"), (F.count("event_type") - F.count_distinct("event_type")).alias("hits"))


# ---------------------------------------------------------------- what callers do with rows


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem")
def u1_column_sum(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "lineitem"), ["l_extendedprice"]).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT batch_id, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM (SELECT o_totalprice, CAST((row_number() OVER () - 1) // 250 AS BIGINT) AS batch_id FROM orders) GROUP BY batch_id")
def u2_batch_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.numbered(scan.read_rows(spark, _path(d, "orders"))).select("file", F.floor(F.col("row_index") / 250).cast("long").alias("batch_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return rows.groupBy("file", "batch_id").agg(F.round(F.sum("p").cast("double") / F.count("*"), 4).alias("mean")).drop("file")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER () AS rn FROM events) WHERE rn <= 25")
def u3_take(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(scan.read_rows(spark, _path(d, "events"))).orderBy("file", "row_index").limit(25).select("event_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def u4_select(spark: SparkSession, d: str) -> DataFrame:
    return scan.read_rows(spark, _path(d, "customer"), ["c_custkey", "c_name"]).where("c_custkey % 2 = 0")


@query("SELECT event_id, row_number() OVER () - 1 AS row_index FROM events")
def u5_with_index(spark: SparkSession, d: str) -> DataFrame:
    return scan.numbered(scan.read_rows(spark, _path(d, "events"))).select("event_id", "row_index")


@query("SELECT count(*) AS n_rows, CAST(ceil(count(*) / 500) AS BIGINT) AS n_batches FROM lineitem")
def u6_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.numbered(scan.read_rows(spark, _path(d, "lineitem"))).select("file", F.floor(F.col("row_index") / 500).alias("b"))
    return rows.groupBy("file", "b").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_batches"))
