"""Coercions and decoders on values chosen for their edges, and properties."""

import datetime
import struct
import uuid
from decimal import ROUND_DOWN, Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import coerce, decode
from tessella.operators import batching
from tessella.plans import registry
from tessella.plans import schema as schemas
from tessella.session import settled
from tessella.sources import footer, scan, sink

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def column(spark, values, kind, f):
    with settled(spark):
        rows = [(i, v) for i, v in enumerate(values)]
        got = spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(got)]


@given(st.lists(st.decimals(-(10**9), 10**9, places=6), min_size=1, max_size=40))
@QUICK
def test_decimals_are_cut(spark, values):
    got = column(spark, [str(v) for v in values], "string", lambda c: coerce.decimal(c, 18, 2))
    assert got == [v.quantize(Decimal("0.01"), ROUND_DOWN) for v in values]


def test_decimal_edges(spark):
    assert column(spark, ["-0.001", "123.45", "1e3", None], "string", lambda c: coerce.decimal(c, 10, 2)) == [Decimal("0.00"), Decimal("123.45"), Decimal("1000.00"), None]


@given(st.lists(st.uuids(), min_size=1, max_size=20))
@QUICK
def test_uuids(spark, values):
    text = [str(v) if i % 3 else v.hex.upper() for i, v in enumerate(values)]
    assert column(spark, text, "string", lambda c: decode.uuid_text(coerce.uuid_bytes(c))) == [str(v) for v in values]


@pytest.mark.parametrize("value", ["xyz", "12", str(uuid.UUID(int=0)) + "0"])
def test_wrong_uuid_raises(spark, value):
    with pytest.raises(Exception, match="not a UUID"):
        column(spark, [value], "string", coerce.uuid_bytes)


def test_half_floats(spark):
    values = [0.0, -0.0, 1.5, -65504.0, 6e-8, float("inf"), 0.333]
    got = column(spark, [bytearray(struct.pack("<e", v)) for v in values], "binary", decode.half_float)
    assert got == [float(np.float16(v)) for v in values]


def test_floats_read_short(spark):
    assert column(spark, [12.3, 0.1, -0.0, float("inf")], "float", decode.shortest) == [12.3, 0.1, -0.0, float("inf")]


@given(st.lists(st.integers(-(2**255), 2**255 - 1), min_size=1, max_size=10))
@QUICK
def test_wide_decimals(spark, values):
    got = column(spark, [bytearray(v.to_bytes(32, "big", signed=True)) for v in values], "binary", lambda c: decode.big_decimal_text(c, 0))
    assert got == [str(v) for v in values]


def test_dates(spark):
    assert [str(x) for x in column(spark, ["2023-01-05", "05/01/2023", "Jan 5, 2023", "?"], "string", coerce.date)] == ["2023-01-05"] * 3 + ["None"]


@pytest.mark.parametrize(("value", "kind"), [("256", "uint8"), ("-1", "uint64"), ("70000", "uint16")])
def test_unsigned_range(spark, value, kind):
    with pytest.raises(Exception, match="out of range"):
        column(spark, [value], "string", lambda c: coerce.unsigned(c, kind))


def test_invalid_utf8_raises(spark):
    with pytest.raises(Exception, match="UTF"):
        column(spark, [bytearray(b"\xc3\x28")], "binary", coerce.text)


def test_required_null_raises(spark, tmp_path):
    want = schemas.define(lambda b: b.field("a", "int32", False))
    with pytest.raises(Exception, match="non-nullable field at a"):
        sink.write(spark.createDataFrame([(None,)], "a string"), str(tmp_path / "x"), schema=want)


def test_rows_and_edges(spark, tmp_path):
    df = sink.rows_frame(spark, [{"a": 1, "b": "x"}, {"a": None}], [{"a": "int32"}, {"b": "string"}])
    sink.write_file(df, str(tmp_path / "one.parquet"))
    assert sorted(scan.each_row(scan.read_rows(spark, str(tmp_path / "one.parquet")), "array"), key=str) == [(1, "x"), (None, None)]
    assert [r for r in scan.each_row(spark.createDataFrame([(1,)], "a int"))] == [{"a": 1}]


def test_pushdown(spark):
    plan = scan.read_rows(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_orderkey > 5")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "GreaterThan(l_orderkey,5)" in plan


def test_stream(spark, tmp_path):
    from tessella.streaming.rows import stream_rows

    df = spark.range(10).withColumn("b", F.lit("x"))
    df.write.parquet(str(tmp_path / "in"))
    q = stream_rows(spark, str(tmp_path / "in"), df.schema, ["id"]).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert spark.table("streamed").count() == 10 and spark.table("streamed").columns == ["id"]


def test_plan_follows_drift(spark):
    """Every row of two files against a plain model of the reference's batch manager."""
    threshold, files = 1_000_000, {"a": [1000] * 130 + [10_000] * 100 + [1500] * 60 + [300] * 70, "b": [0] * 12 + [7, 900, 40] * 60 + [90_000] * 75}
    want = {}
    for file, sizes in files.items():
        samples, recent, now = [], [], 100
        for i, s in enumerate(sizes, 1):
            recent = [*recent[-9:], s]
            if len(samples) < 100:
                samples.append(s)
                if len(samples) >= 10 and sum(samples) // len(samples) > 0:
                    now = max(10, int(threshold * 0.8) // (sum(samples) // len(samples)))
            elif i % 50 == 0:
                a, m = sum(recent) // len(recent), sum(samples) // len(samples)
                if a > 2 * m or a < m // 2:
                    now = max(10, int(threshold * 0.8) // a)
            want[file, i] = (now, sum(recent) // len(recent))
    rows = spark.createDataFrame([(f, i, s) for f, x in files.items() for i, s in enumerate(x)], "file string, at long, bytes long").repartition(3)
    got = {(r["file"], r["n"]): (r["batch_size"], r["recent_mean"]) for r in batching.plan(rows, "at", "bytes", threshold, parts="file").collect()}
    assert got == want and len({want["a", i][0] for i in range(101, 361)}) > 2


def test_batches_of_several_files(spark, tmp_path):
    """Batches never cross files, and a file's last one is short."""
    for i in range(2):
        spark.range(2500 * i, 2500 * i + 2500).toDF("l_orderkey").withColumn("l_quantity", F.lit(1.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").select(F.col("l_orderkey").alias("event_id"), F.lit("x").alias("event_type"), F.col("l_quantity").alias("o_totalprice")).write.parquet(f"{tmp_path}/events.parquet")
    q = registry.QUERIES
    rows = q["s2_scan_batches"](spark, str(tmp_path)).collect()
    assert sorted((r["batch_id"], r["n"]) for r in rows) == [(0, 1000), (0, 1000), (1, 1000), (1, 1000), (2, 500), (2, 500)]
    assert all(r["last_key"] - r["first_key"] == r["n"] - 1 for r in rows)
    assert q["u6_counts"](spark, str(tmp_path)).first()["n_batches"] == 10
    first = [r["event_id"] for r in q["u3_take"](spark, str(tmp_path)).collect()]
    assert max(first) - min(first) == 24


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_metadata_at_other_scales(spark, sf):
    c = duckdb.connect()
    sql = registry.oracles(f"/root/testdata/{sf}")
    for name in ("m2_file_metadata", "m3_fields", "m5_row_groups", "m6_column_chunks", "m7_chunk_places", "m8_encodings"):
        df = registry.QUERIES[name](spark, f"/root/testdata/{sf}")
        got = c.execute(sql[name])
        names = [x[0] for x in got.description]
        assert sorted(map(str, df.select(*names).toPandas().values.tolist())) == sorted(map(str, got.fetchdf().values.tolist()))


def conformed(spark, values, kind, spec):
    with settled(spark):
        return [r["x"] for r in sink.conformed(spark.createDataFrame([(v,) for v in values], f"x {kind}"), schemas.normalise([{"name": "x", **spec}])).collect()]


def test_nested_kinds_hold(spark):
    assert conformed(spark, [["255", None]], "array<string>", {"type": "list<uint8>"}) == [[255, None]]
    with pytest.raises(Exception, match="out of range for uint8"):
        conformed(spark, [["300"]], "array<string>", {"type": "list<uint8>"})
    with pytest.raises(Exception, match="out of range for uint16"):
        conformed(spark, [{"k": 70000}], "map<string,int>", {"type": "map", "key": "string", "value": {"type": "uint16"}})
    some = {"type": "struct", "fields": [{"name": "a", "type": "int8"}, {"name": "b", "type": "list", "item": {"type": "binary", "format": "uuid"}}]}
    assert conformed(spark, [{"a": 1}], "struct<a: int>", some)[0].asDict() == {"a": 1, "b": None}
    assert conformed(spark, [None], "struct<a: int>", some) == [None]
    u = uuid.UUID(int=77)
    assert conformed(spark, [(2, [u.hex.upper()])], "struct<a: int, b: array<string>>", some)[0].asDict() == {"a": 2, "b": [str(u)]}


def test_free_dates_write(spark):
    assert [str(x) for x in conformed(spark, ["Jan 5, 2023", "2023/01/05", None], "string", {"type": "date32"})] == ["2023-01-05", "2023-01-05", "None"]
    with pytest.raises(Exception, match="not a date"):
        conformed(spark, ["soon"], "string", {"type": "date32"})


def test_times_and_floats_write(spark):
    at = datetime.datetime(2023, 1, 5, 1, 2, 3, 456789)
    assert conformed(spark, [at], "timestamp", {"type": "time_millis"}) == [3723456]
    assert conformed(spark, [at], "timestamp", {"type": "timestamp_nanos"})[0] % 10**9 == 456789000
    assert conformed(spark, [" 1.5", "NaN"], "string", {"type": "float32"})[0] == 1.5


def test_offsets(spark):
    assert column(spark, ["2023-01-01T00:00:00+09:00", "2023-01-01T00:00:00.5-0530", "2023-01-01T00:00Z", "2023-01-01T00:00:00", None], "string", coerce.offset) == ["+09:00", "-05:30", "+00:00", None, None]


@pytest.mark.parametrize("spec", [{"type": "list"}, {"type": "map", "key": "string"}, {"type": "list", "item": {"type": "string", "zone": 1}}, {"type": "struct", "fields": [{"type": "string"}]}, {}])
def test_wrong_nodes_raise(spec):
    with pytest.raises(schemas.SchemaError):
        schemas.normalise([{"name": "x", **spec}])


def test_failures_are_logged(spark, caplog):
    with caplog.at_level("ERROR", logger="tessella"), pytest.raises(Exception, match="reading"):
        scan.read_rows(spark, "/nowhere/at/all.parquet")
    assert "SourceError" in caplog.text


def test_truncated_file(spark, tmp_path):
    whole = Path("/root/testdata/sf0.001/nation.parquet").read_bytes()
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(scan.SourceError):
        scan.opened(spark, str(tmp_path / "cut.parquet"))


def test_row_groups_follow_the_size(spark, tmp_path):
    df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1)
    for size, least in ((1 << 20, 5), (1 << 30, 1)):
        sink.write(df, f"{tmp_path}/{size}", row_group_bytes=size, dictionary=False)
        n = footer.footers(spark, f"{tmp_path}/{size}/*.parquet", "row_groups").count()
        assert n >= least if least > 1 else n == 1


def size_of(v, kind, core=False):
    """A plain model of both size estimates."""
    if v is None:
        return 0 if core else 1
    if kind in ("int", "long"):
        return 4 if kind == "int" else 8
    if kind == "string":
        return len(v.encode()) + 24
    if kind[0] == "list":
        if not core:
            return 24 + sum(size_of(x, kind[1]) for x in v)
        return 24 if not v else 24 + sum(size_of(x, kind[1], True) for x in v[:5]) // len(v[:5]) * len(v)
    if kind[0] == "map":
        pairs = [size_of(k, kind[1], core) + size_of(x, kind[2], core) for k, x in v.items()]
        if not core:
            return 48 + sum(pairs)
        return 32 if not v else 32 + sum(pairs[:5]) // len(pairs[:5]) * len(pairs)
    return (24 if core else 48) + sum(size_of(x, k, core) + (0 if core else len(n) + 24) for (n, k), x in zip(kind[1], v, strict=True))


def test_sizes_of_nested_values(spark):
    kinds = [("list", "string"), ("map", "string", "int"), ("struct", [("ab", "string"), ("c", ("list", "long"))]), ("list", ("list", "int"))]
    ddl = "a array<string>, b map<string,int>, c struct<ab: string, c: array<bigint>>, d array<array<int>>"
    rows = [
        (["x", "yy" * 40, None, "z", "é", "w" * 9, "v"], {"k": 1, "kk": None}, ("s", [1, 2]), [[1], [], None, [2, 3]]),
        ([], {}, (None, None), []),
        (None, None, None, None),
        (["q"] * 12, {str(i) * i: i for i in range(1, 9)}, ("é", []), [[1] * 7] * 6),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")
    for core in (False, True):
        got = {r["i"]: r["n"] for r in df.select("i", batching.row_size(df.drop("i").schema, core).alias("n")).collect()}
        assert got == {i: sum(size_of(v, k, core) for v, k in zip(r, kinds, strict=True)) for i, r in enumerate(rows)}


def test_what_needs_a_format():
    s = schemas.define(lambda b: b.field("a", "date32").field("b", "timestamp").field("c", "decimal(9,2)").field("d", "string").field("e", "int8"))
    assert [schemas.requires_format(f.dataType) for f in s] == [True, True, True, False, False]
