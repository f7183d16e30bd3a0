"""How large values are, and where batches of rows end."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..sources.scan import quoted

# Bytes by type in the adapter's estimate and in the core's; a header for each variable-sized value.
_FLAT = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}
HEADER, MAP_HEADER, DECIMAL = 24, 48, 17
CORE_MAP_HEADER, CORE_DECIMAL, CORE_SAMPLE = 32, 16, 5


def _size(c: Column, kind: T.DataType, core: bool) -> Column:
    none = 0 if core else 1
    flat = _FLAT.get(kind.simpleString())
    if flat is not None:
        out = F.lit(flat)
    elif isinstance(kind, T.DecimalType):
        out = F.lit(CORE_DECIMAL if core else DECIMAL)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        out = F.octet_length(c) + HEADER
    elif isinstance(kind, T.ArrayType):
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + _size(x, kind.elementType, core))
        if core:
            some = F.slice(c, 1, CORE_SAMPLE)
            out = F.when(F.size(c) == 0, F.lit(HEADER)).otherwise(HEADER + F.floor(total(some) / F.greatest(F.size(some), F.lit(1))) * F.size(c))
        else:
            out = HEADER + total(c)
    elif isinstance(kind, T.MapType):
        pairs = F.map_entries(c)
        total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + _size(x["key"], kind.keyType, core) + _size(x["value"], kind.valueType, core))
        if core:
            some = F.slice(pairs, 1, CORE_SAMPLE)
            out = F.when(F.size(pairs) == 0, F.lit(CORE_MAP_HEADER)).otherwise(CORE_MAP_HEADER + F.floor(total(some) / F.greatest(F.size(some), F.lit(1))) * F.size(pairs))
        else:
            out = MAP_HEADER + total(pairs)
    elif isinstance(kind, T.StructType):
        out = F.lit(HEADER if core else MAP_HEADER)
        for f in kind:
            part = _size(c[f.name], f.dataType, core)
            out = out + (part if core else part + len(f.name.encode()) + HEADER)
    else:
        raise ArgumentError(f"no size for {kind.simpleString()}")
    return F.when(c.isNull(), F.lit(none).cast("long")).otherwise(out.cast("long"))


def row_size(schema: T.StructType, core: bool = False) -> Column:
    """The estimated bytes of a row. ``core``: the other estimate, which averages the first five items of a list or map."""
    total = F.lit(0).cast("long")
    for f in schema:
        total = total + _size(F.col(quoted(f.name)), f.dataType, core)
    return total


def plan(sizes: DataFrame, order: str, size: str, threshold: int = 64 << 20, samples: int = 100, initial: int = 100, least: int = 10, parts: str | None = None) -> DataFrame:
    """The planned batch size after each row of ``sizes``, with n, its number, and recent_mean, of the last ten.

    ``initial`` until ``least`` rows, then by the mean size of the rows so far, up to ``samples``. After those, every 50th row
    whose recent mean is over twice or under half of the samples' sets it by the recent mean; it stays until the next that does.
    Each value of ``parts`` (a file) is one stream; without, all rows are.
    """
    w = Window.partitionBy(parts) if parts else Window.partitionBy(F.lit(0))
    so_far = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = w.orderBy(order).rowsBetween(-9, 0)
    n = F.count("*").over(so_far)
    rows = sizes.select(*([parts] if parts else []), order, size, n.alias("n"), F.floor(F.avg(size).over(last)).cast("long").alias("recent_mean"))
    rows = rows.withColumn("_mean", F.floor(F.avg(F.when(F.col("n") <= samples, F.col(size))).over(so_far)).cast("long"))
    fit = lambda mean: F.greatest(F.lit(least), F.floor(F.lit(threshold * 8 // 10) / F.greatest(mean, F.lit(1)))).cast("long")
    mean, recent, at = F.col("_mean"), F.col("recent_mean"), F.col("n")
    drifted = (recent > mean * 2) | (recent < F.floor(mean / 2))
    new = F.when((at >= least) & (at <= samples) & (mean > 0), fit(mean)).when((at > samples) & (at % 50 == 0) & drifted, fit(recent))
    rows = rows.withColumn("_new", new)
    return rows.withColumn("batch_size", F.coalesce(F.last("_new", ignorenulls=True).over(so_far), F.lit(initial)).cast("long")).drop("_new", "_mean")


def core_batch_size(mean: Column, threshold: int = 100 << 20) -> Column:
    return F.greatest(F.lit(10), F.floor(F.lit(threshold) / F.greatest(mean, F.lit(1)))).cast("long")


#: Rows that a task orders at once, and how many of them are looked at to cut the rows into such chunks.
CHUNK, SAMPLES = 1 << 19, 64


def _cuts(keys: DataFrame) -> list[tuple]:
    """Sorted keys that cut the rows into chunks of some CHUNK rows."""
    rows = keys.count()
    chunks = -(-rows // CHUNK)
    if chunks < 2:
        return []
    some = sorted(map(tuple, keys.sample(min(1.0, chunks * SAMPLES / rows), seed=0).collect()))
    return sorted({some[i * len(some) // chunks] for i in range(1, chunks)}) if some else []


def _chunked(rows: DataFrame, key: list[Column], cuts: list[tuple]) -> DataFrame:
    """With chunk: how many of the sorted ``cuts`` are at most a row's key of three numbers.

    The cuts are halved with each projection; these stay apart, as Spark merges none whose result is used twice.
    """
    rows = rows.withColumn("chunk", F.lit(0))
    steps = len(cuts).bit_length()
    padded = [*cuts, *[(2, 0, 0)] * ((1 << steps) - 1 - len(cuts))]
    first, second, third = (F.array(*[F.lit(int(c[i])).cast("long") for c in padded]) for i in range(3))
    for k in reversed(range(steps)):
        a, b, c = (F.get(x, F.col("chunk") + ((1 << k) - 1)) for x in (first, second, third))
        below = (a < key[0]) | ((a == key[0]) & ((b < key[1]) | ((b == key[1]) & (c <= key[2]))))
        rows = rows.withColumn("chunk", F.col("chunk") + F.when(below, F.lit(1 << k)).otherwise(F.lit(0)))
    return rows


class _Filling:
    """How rows fill batches of ``batch_size`` rows or ``threshold`` bytes. A state is the rows and bytes in the batch that is open."""

    def __init__(self, batch_size: int, threshold: int) -> None:
        self.batch_size, self.threshold = min(batch_size, 1 << 62), min(threshold, 1 << 62)

    def rows(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """total, the bytes of the first i rows, and after, where a batch ends that begins at row i: past the rows if they don't end it."""
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
        return total, np.minimum(np.arange(len(sizes)) + self.batch_size, np.searchsorted(total, total[:-1] + self.threshold))

    def first(self, total: np.ndarray, n: Any, held: Any) -> Any:
        """Where a batch ends that has ``n`` rows and ``held`` bytes before these rows."""
        return np.minimum(self.batch_size - n, np.searchsorted(total, self.threshold - held))

    @staticmethod
    def walked(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a batch that begins at row i: where the one begins that the rows leave open, and how many end before it."""
        m = len(after)
        last, ended = np.append(np.where(after <= m, after, np.arange(m)), m), np.append(after <= m, False).astype(np.int64)
        while ((further := last[last]) != last).any():
            ended, last = ended + ended[last], further
        return last, ended

    @staticmethod
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """The rows that share part and chunk, an Arrow batch at a time."""
        for b in batches:
            if not b.num_rows:
                continue
            parts, chunks = b.column("part"), b.column("chunk").to_numpy()
            codes = parts.dictionary_encode("encode").indices.to_numpy()
            ends = np.flatnonzero((np.diff(codes) != 0) | (np.diff(chunks) != 0)) + 1
            for i, j in pairwise([0, *ends.tolist(), b.num_rows]):
                yield (parts[i].as_py(), int(chunks[i])), b.slice(i, j - i)

    def ways(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a chunk does to a state. Row 0 has its rows and bytes; row k what is left open if its first k rows, of ``reach`` bytes, end the batch."""
        for _, runs in groupby(self.runs(batches), key=lambda x: x[0]):
            seen, size, n, held, ended, reach = 0, 0, *(np.zeros(0, np.int64) for _ in range(4))
            for (part, chunk), run in runs:
                total, after = self.rows(run.column("bytes").to_numpy())
                last, inside = self.walked(after)
                m = len(after)
                to = self.first(total, n, held)
                at = np.minimum(to, m)
                n, held = np.where(to > m, n + m, m - last[at]), np.where(to > m, held + total[m], total[m] - total[last[at]])
                ended = np.where(to > m, ended, ended + 1 + inside[at])
                # no batch goes on for more rows than this, so that a few rows stand for a chunk
                k = max(0, min(m, self.batch_size - seen, int(np.searchsorted(total[:-1], self.threshold - size))))
                new = last[1 : k + 1]
                n, held = np.append(n, m - new), np.append(held, total[m] - total[new])
                ended, reach = np.append(ended, inside[1 : k + 1]), np.append(reach, size + total[1 : k + 1])
                seen, size = seen + m, size + int(total[m])
            columns = [np.arange(len(n) + 1), np.insert(reach, 0, size), np.insert(n, 0, seen), np.insert(held, 0, 0), np.insert(ended, 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.string()), pa.array([chunk] * len(columns[0]), pa.int32()), *map(pa.array, columns)], ["part", "chunk", "entry", "reach", "n", "held", "ended"])

    def starts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch and the state in which each chunk begins, from the ways of all chunks in order."""
        now, then, is_open = object(), (0, 0, 0), False
        for b in batches:
            out = []
            for part, chunk, entry, reach, n, held, ended in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if entry == 0:
                    batch, rows, size = (0, 0, 0) if part != now else then
                    out.append((part, chunk, batch, rows, size))
                    now, then, is_open = part, (batch, rows + n, size + reach), True
                elif is_open and (rows + entry >= self.batch_size or size + reach >= self.threshold):
                    then, is_open = (batch + 1 + ended, n, held), False
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["of", "chunk_of", "batch", "n", "held"])

    def fill(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's batch, from the state in which its chunk begins."""
        for _, runs in groupby(self.runs(batches), key=lambda x: x[0]):
            batch = None
            for _, run in runs:
                if batch is None:
                    batch, n, held = (run.column(c)[0].as_py() for c in ("batch", "n", "held"))
                total, after = self.rows(run.column("bytes").to_numpy())
                m, ends = len(after), []
                to, after = int(self.first(total, n, held)), after.tolist()
                while to <= m:
                    ends.append(to)
                    to = after[to] if to < m else m + 1
                begun = np.zeros(m + 1, np.int64)
                begun[ends] = 1
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in ("part", "at", "bytes")), pa.array(batch + np.cumsum(begun[:m]))], ["part", "at", "bytes", "batch"])
                n, held = (m - ends[-1], int(total[m] - total[ends[-1]])) if ends else (n + m, held + int(total[m]))
                batch += len(ends)


def flushes(sizes: DataFrame, order: str, size: str, batch_size: int, threshold: int, parts: str, ties: str | None = None) -> DataFrame:
    """``sizes`` with batch: rows in ``order`` (nulls last) within each value of ``parts`` (a file) fill a batch until it has
    ``batch_size`` rows or ``threshold`` bytes. ``ties``: a number by which rows of equal ``order`` can be dealt to several tasks.

    The fill depends on all rows before. So rows are cut into chunks of their order; each chunk is summed up by what it leaves open for
    every place where the batch before it can end, the sums are followed in order, and each chunk is filled from the state found for it.
    Those places are few if batches have few rows against CHUNK; of longer ones, a part's sums grow to its own number of rows.
    """
    if batch_size < 1 or threshold < 1:
        raise ArgumentError("batch_size and threshold must be greater than 0")
    long = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    rows = sizes.select(F.col(parts).cast("string").alias("part"), F.col(order).cast("long").alias("at"), F.col(size).cast("long").alias("bytes"), (long(F.col(ties)) if ties else F.lit(0).cast("long")).alias("tie"))
    key = [F.col("at").isNull().cast("long"), long(F.col("at")), F.col("tie")]
    cuts = _cuts(rows.select(*(k.alias(f"key{i}") for i, k in enumerate(key))))
    rows = _chunked(rows, key, cuts).drop("tie")
    # rows alike in all of these are the same for a batch, so that both passes see one order
    in_order = [F.col("part"), F.col("chunk"), F.col("at").asc_nulls_last(), F.col("bytes")]
    filling = _Filling(batch_size, threshold)
    if cuts:
        rows = rows.repartitionById(len(cuts) + 1, "chunk")
        ways = rows.sortWithinPartitions(*in_order).mapInArrow(filling.ways, "part string, chunk int, entry long, reach long, n long, held long, ended long")
        starts = ways.repartition("part").sortWithinPartitions("part", "chunk", "entry").mapInArrow(filling.starts, "of string, chunk_of int, batch long, n long, held long")
        # left and null-safe: no filter is inferred for either side, so that both branches have the same shuffle
        rows = rows.join(F.broadcast(starts), F.col("part").eqNullSafe(F.col("of")) & F.col("chunk").eqNullSafe(F.col("chunk_of")), "left").drop("of", "chunk_of")
    else:
        rows = rows.repartition("part").withColumns({c: F.lit(0).cast("long") for c in ("batch", "n", "held")})
    return rows.sortWithinPartitions(*in_order).mapInArrow(filling.fill, "part string, at long, bytes long, batch long")
