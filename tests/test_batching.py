"""Flushes that are cut into chunks, against a plain model."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import batching
from tessella.plans import registry


def model(rows, batch_size, threshold):
    """The sizes of each part's batches."""
    out, part = {}, object()
    for p, _, s in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0)):
        if p != part:
            part, batch, n, held = p, 0, 0, 0
        n, held = n + 1, held + s
        out.setdefault((p, batch), []).append(s)
        if n >= batch_size or held >= threshold:
            batch, n, held = batch + 1, 0, 0
    return out


@pytest.mark.parametrize(("batch_size", "threshold"), [(7, 1 << 80), (1 << 80, 400), (7, 90), (60, 900), (1, 1), (1 << 40, 1 << 40)])
def test_chunks_fill_as_one_stream(spark, monkeypatch, batch_size, threshold):
    monkeypatch.setattr(batching, "CHUNK", 40)
    at = random.Random(batch_size + threshold)
    rows = [(p, i, at.choice([0, 1, 20, 20, 33, 150])) for p, n in (("a", 700), ("b", 333), ("c", 1), (None, 90)) for i in at.sample(range(-(10**6), 10**6), n)]
    rows.append(("a", None, 5))
    at.shuffle(rows)
    got = batching.flushes(spark.createDataFrame(rows, "part string, at long, bytes long"), "at", "bytes", batch_size, threshold, "part").collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r["part"] is None, r["part"] or "", r["at"] is None, r["at"] or 0)):
        mine.setdefault((r["part"], r["batch"]), []).append(r["bytes"])
    assert mine == model(rows, batch_size, threshold)


def test_arrow_batches_within_a_chunk(spark, monkeypatch):
    """A chunk's sum goes on from one Arrow batch to the next."""
    monkeypatch.setattr(batching, "CHUNK", 300)
    at = random.Random(1)
    rows = [("a", i, at.choice([0, 1, 20, 33, 150])) for i in range(1000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = batching.flushes(spark.createDataFrame(rows, "part string, at long, bytes long"), "at", "bytes", 25, 700, "part").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    mine = {}
    for r in sorted(got, key=lambda r: r["at"]):
        mine.setdefault(("a", r["batch"]), []).append(r["bytes"])
    assert mine == model(rows, 25, 700)


@pytest.mark.parametrize(("key", "ties"), [("id", []), ("5L", ["row_index"]), ("CAST(NULL AS BIGINT)", ["row_index"])])
def test_no_task_takes_a_whole_file(spark, monkeypatch, key, ties):
    """Not even if all its keys are equal or null."""
    monkeypatch.setattr(batching, "CHUNK", 1000, raising=False)
    rows = spark.range(10_000).select(F.expr(key).alias("at"), F.lit(8).alias("bytes"), F.lit("a").alias("part"), F.col("id").alias("row_index"))
    got = batching.flushes(rows, "at", "bytes", 50, 1 << 26, "part", *ties)
    shares = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 4 and max(shares) < 4000 and sum(shares) == 10_000
    assert sorted((r["batch"], r["count"]) for r in got.groupBy("batch").count().collect()) == [(i, 50) for i in range(200)]


def test_flushes_of_null_ids(spark, tmp_path):
    """Null ids come last, as in the SQL."""
    rows = [(None if i % 7 == 0 else i, float(i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.QUERIES["z6_flushes"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        names = [d[0] for d in c.execute(registry.ORACLE_SQL["z6_flushes"]).description]
        want = sorted(c.fetchall())
    assert names == ["batch", "n", "first_id"] and got == want
