"""What the operators of this package share: scratch tables, order, filters, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tessella/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder (in folders of ``by``) and read again: lineage ends here and lost executors cost nothing.

    Shuffle files go when the driver collects what refers to them, so it is asked to, now that they are not needed.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._scratch = path
    _released()
    spark.sparkContext._jvm.System.gc()
    return out


def dropped(df: DataFrame, folder: str = "") -> None:
    """Deletes the files of a ``stored`` frame (or those of one folder); nothing may read them or what was made of them lazily any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{df._scratch}/{folder}" if folder else df._scratch)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def partitions(spark: SparkSession, size: int = 0, per: int = 128 << 20) -> int:
    """Partitions for ``size`` bytes: the session's number or more, so that none exceeds ``per``."""
    return max(setting(spark, "spark.sql.shuffle.partitions", 200), -(-size // per))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


# ---------------------------------------------------------------- memory of Python workers

#: What a worker keeps from task to task, by name: how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def _released() -> None:
    """Gives free memory back to the system: what the C library and Arrow hold for later, the next operator's tasks have no use for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow. Workers live on from operator to operator: of ``CACHES`` only ``keeps`` stays, and free memory goes back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in CACHES.items():
            if name != keeps:
                forget()
        try:
            yield from f(batches)
        finally:
            _released()

    return run


#: Bytes of an Arrow batch that JVM and worker both hold, where an operator asks for small ones.
BATCH = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """Plans that run in this block hand Python workers Arrow batches of some ``size`` bytes; what was set before comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ---------------------------------------------------------------- order


def bounds_of(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` values of the long column ``key`` that cut its rows into even ranges."""
    if n < 2:
        return []
    cuts = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, F.array(*map(F.lit, cuts)), max(10_000, 20 * n)).alias("q")).first()
    return sorted(set(row["q"] or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are at most ``key``; null keys go to bucket 0.

    The sorted bounds are looked through in two steps, of about the root of their number each.
    """
    if not bounds:
        return F.lit(0)
    size = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    longs = lambda x: F.array(*[F.lit(int(b)).cast("long") for b in x])
    below = lambda x: F.size(F.filter(x, lambda b: b <= key))
    # a row's bounds count only if its first one is at most the key
    row = below(longs(r[0] for r in rows))
    found = (row - 1) * size + below(F.element_at(F.array(*map(longs, rows)), F.greatest(row, F.lit(1))))
    return F.coalesce(F.when(row == 0, F.lit(0)).otherwise(found), F.lit(0))


def with_starts(df: DataFrame, key: str, amount: str, start: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over all rows before, in order of ``key`` (then ``ties``).

    Rows are summed in ranges of ``key``; only one sum a range meets the driver.
    """
    spark = df.sparkSession
    bounds = bounds_of(df, key, min(8192, partitions(spark)))
    df = df.withColumn("_range", bucket_of(F.col(key), bounds))
    before, total = {}, 0
    for r in sorted(df.groupBy("_range").agg(F.sum(amount).alias("s")).collect()):
        before[r["_range"]] = total
        total += r["s"] or 0
    held = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(len(bounds) + 1)])
    w = Window.partitionBy("_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return df.withColumn(start, (F.element_at(held, F.col("_range") + 1) + inside).cast("long")).drop("_range")


# ---------------------------------------------------------------- CRC-32 of parts


def _square(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


def _times(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def _zero_matrices(n: int = 64) -> list[list[int]]:
    """The maps of a CRC-32 register over 2^k zero bytes, for k below ``n``."""
    bit = [0xEDB88320] + [1 << i for i in range(31)]
    m = _square(_square(_square(bit)))
    out = []
    for _ in range(n):
        out.append(m)
        m = _square(m)
    return out


_ZEROS: list[list[list[int]]] = []


def _byte_tables(m: list[int]) -> list[list[int]]:
    """The map ``m`` as four tables, one for each byte of its argument."""
    return [[_times(m, v << 8 * i) for v in range(256)] for i in range(4)]


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a byte string from (CRC-32, length) of its consecutive parts."""
    if not _ZEROS:
        _ZEROS.extend(map(_byte_tables, _zero_matrices(40)))
    crc = 0
    for c, n in parts:
        if crc:
            k = 0
            while n:
                if n & 1:
                    t0, t1, t2, t3 = _ZEROS[k]
                    crc = t0[crc & 255] ^ t1[crc >> 8 & 255] ^ t2[crc >> 16 & 255] ^ t3[crc >> 24]
                n >>= 1
                k += 1
        crc ^= c
    return crc


# ---------------------------------------------------------------- hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2^64, and of its inverse; the longest so far are kept."""
    if not _powers or _powers[0].size < n:
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if out[0].size > 1 << 23:  # for one very long text only
            return out[0][:n], out[1][:n]
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def span_hashes(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``x`` from each ``begin`` to its ``end``, by prefix sums."""
    up, down = powers(x.size + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: x.size], dtype=np.uint64)]
        return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


# ---------------------------------------------------------------- records dealt by hash

DEALT = "kind int, part int, data binary"


def deal(kind: int, records: np.ndarray, parts: int) -> pa.RecordBatch:
    """``records`` (a structured array with a hash ``h``) as a byte string for each part that has some: the JVM moves few rows."""
    part = (records["h"] % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if part.size else np.zeros(0, dtype=np.int64)
    end = np.r_[begin[1:], part.size]
    data = [records[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=False)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(data), pa.int32()), pa.array(part[begin]), pa.array(data, pa.binary())], ["kind", "part", "data"])


def gathered(dealt: DataFrame, dtype: np.dtype, f: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, whole: bool = True) -> DataFrame:
    """``f`` of all records of each part; a part's are in memory at once, so parts are many enough to be small.

    Not ``whole``: of each byte string where it lies, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for p, data in zip(b.column(0), b.column(1), strict=True):
                if (p := p.as_py()) != part or not whole:
                    if held:
                        yield from f(np.concatenate(held))
                    part, held = p, []
                held.append(np.frombuffer(data.as_py(), dtype=dtype))
        if held:
            yield from f(np.concatenate(held))

    dealt = dealt.select("part", "data")
    if whole:
        dealt = dealt.repartition(partitions(dealt.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lean(run), schema)


# ---------------------------------------------------------------- fixed-size membership filters


class BitFilter:
    """A set of 64-bit hashes as a bitmap of 2^``bits`` bits: its size is fixed, whatever the data.

    A member is always found. Others pass by chance (more as it fills), so it may only thin out
    candidates that an exact step looks at again. One hash a member, by its low bits.
    """

    BLOCK = 15  # bits of a block's own address

    def __init__(self, bits: int, data: bytes | bytearray):
        self.bits, self.map = bits, np.frombuffer(data, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << self.bits) - 1)
        return (self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    @classmethod
    def build(cls, df: DataFrame, column: str, bits: int = 27) -> BitFilter:
        """``column``: long. The driver gets at most 2^``bits`` bits, in blocks that tasks have filled."""
        low = (1 << bits) - 1

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[int, np.ndarray] = {}
            for b in batches:
                at = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64(low)).astype(np.int64)
                part = at >> cls.BLOCK
                for cut in np.split(np.arange(at.size), np.flatnonzero(np.diff(part)) + 1):
                    if cut.size:
                        block = blocks.setdefault(int(part[cut[0]]), np.zeros(1 << cls.BLOCK, dtype=bool))
                        block[at[cut] & ((1 << cls.BLOCK) - 1)] = True
            for k, v in blocks.items():
                yield pa.RecordBatch.from_pydict({"k": [k], "v": [np.packbits(v, bitorder="little").tobytes()]})

        n = min(partitions(df.sparkSession), 1 << max(0, bits - cls.BLOCK))
        rows = (
            df.select((F.col(column).bitwiseAND(F.lit(low))).alias("h"))
            .distinct()
            .repartition(n, F.shiftright("h", cls.BLOCK))
            .mapInArrow(lean(fill), "k long, v binary")
        )
        whole = bytearray(max(1, 1 << (bits - 3)))
        size = 1 << (cls.BLOCK - 3)
        for r in rows.toLocalIterator():
            whole[r["k"] * size : (r["k"] + 1) * size] = r["v"]
        return cls(bits, whole)


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes. Each step aggregates the
    neighbours of a node to their minimum before any join. Nodes with more than a thousandth of all links, and a thousand at least,
    are under 2,000 whatever the graph: their minima are broadcast, so that their links meet in no one task. Each step's result is
    written to the shared folder.
    """
    spark = links.sparkSession
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "links")
    count = edges.count()

    def with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
        many = max(1000, count // 1000)
        hot = F.broadcast(least.where(F.col("n") > many).select("u", "m"))
        return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(least.where(F.col("n") <= many).select("u", "m"), "u"))

    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "links")
        number = after.count()
        same = number == count and not after.join(edges, ["u", "v"], "left_anti").take(1)
        dropped(edges)
        edges, count = after, number
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def crc_of(data: bytes) -> int:
    return zlib.crc32(data)


# ---------------------------------------------------------------- which hashes are in several documents


class Levels:
    """How common hashes are, in 4 bits for each of 2^``bits`` slots: the bit length of the count less one, at most 15.

    Its size is fixed. Hashes of one slot get the level of the most common of them, so levels are at least the true ones.
    """

    def __init__(self, bits: int, data: bytes | bytearray):
        self.bits, self.map = bits, np.frombuffer(data, dtype=np.uint8)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << self.bits) - 1)
        return self.map[(at >> np.uint64(1)).astype(np.int64)] >> ((at & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & np.uint8(15)


class Twofold:
    """A set of 64-bit hashes as a bitmap of 2^(``bits`` - ``fold``) bits, two for each member in one block: others pass by chance seldom while it is sparse."""

    def __init__(self, bits: int, fold: int, data: bytes | bytearray):
        self.bits, self.fold, self.map = bits, fold, np.frombuffer(data, dtype=np.uint8)

    @staticmethod
    def slots(known: np.ndarray, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Both bits in its block of a hash, by the 32 bits that the census knows it by."""
        shift = np.uint32(fold)
        return (known & np.uint32((1 << Census.BLOCK) - 1)) >> shift, (known * np.uint32(0x9E3779B1) >> np.uint32(32 - Census.BLOCK)) >> shift

    def has(self, hashes: np.ndarray) -> np.ndarray:
        part, known = Census.address(hashes, self.bits)
        base = part << np.uint64(Census.BLOCK - self.fold)
        found = np.ones(hashes.size, dtype=bool)
        for slot in self.slots(known, self.fold):
            left = np.flatnonzero(found)  # the second bit counts for few
            at = base[left] + slot[left]
            found[left] = self.map[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return found


class Census:
    """Counts 64-bit hashes over a whole corpus in little room, to learn which are in two documents or in many.

    A hash is known by its block of the filters (bits 17 to ``bits`` - 1: 10 bits, or more for larger filters) and 32 more. Tasks count theirs
    and send a block's as arrays, the counts of those over 1 alone, which come first. Hashes that share those bits
    count together, so the filters may hold more than they should, never less.
    """

    BITS, BLOCK = 27, 17
    SCHEMA = "part int, hashes binary, counts binary"

    def __init__(self, most: int = 3_000_000, bits: int = BITS):
        self.held: list[np.ndarray] = []
        self.size, self.most, self.bits = 0, most, bits

    @classmethod
    def address(cls, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and the 32 bits it is known by there."""
        part = hashes >> np.uint64(cls.BLOCK) & np.uint64((1 << bits - cls.BLOCK) - 1)
        known = hashes & np.uint64((1 << cls.BLOCK) - 1) | (hashes >> np.uint64(bits) & np.uint64((1 << 32 - cls.BLOCK) - 1)) << np.uint64(cls.BLOCK)
        return part, known.astype(np.uint32)

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``hashes``: different ones of one document, or such runs of several in turn."""
        part, low = self.address(hashes, self.bits)
        self.held.append(part << np.uint64(32) | low)
        self.size += hashes.size
        if self.size > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        known = np.concatenate(self.held)
        self.held, self.size = [], 0
        # in place and then block by block: beside all the hashes there are only arrays of one block
        known.sort()
        ends = np.searchsorted(known, np.arange(1, (1 << self.bits - self.BLOCK) + 1, dtype=np.uint64) << np.uint64(32))
        begins = np.r_[0, ends[:-1]]
        parts = np.flatnonzero(begins < ends)
        hashes, counts = [], []
        for a, b in zip(begins[parts].tolist(), ends[parts].tolist(), strict=True):
            own = known[a:b]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low, n = own[first].astype(np.uint32), np.minimum(np.diff(first, append=own.size), 65535).astype(np.uint16)
            many = n > 1
            hashes.append(np.r_[low[many], low[~many]].tobytes())
            counts.append(n[many].tobytes())
        del known, own
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["part", "hashes", "counts"])

    @classmethod
    def _maps(cls, df: DataFrame, each: list[int], form: Callable[[np.ndarray, np.ndarray], list[bytes]], bits: int) -> list[bytearray]:
        """``form`` turns a block's hashes (32 bits) and counts into byte strings of ``each`` bytes, one for each map; whole maps meet on the driver."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, hashes, counts = None, [], []

            def summed() -> tuple[np.ndarray, np.ndarray]:
                known, at = np.unique(np.concatenate(hashes), return_inverse=True)
                return known, np.bincount(at, np.concatenate(counts).astype(np.float64))

            def done() -> pa.RecordBatch:
                known, n = summed()
                return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "blocks": pa.array([form(known, n)], pa.list_(pa.binary()))})

            for b in batches:
                for p, h, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if p != part:
                        if part is not None:
                            yield done()
                        part, hashes, counts = p, [], []
                    hashes.append(np.frombuffer(h, dtype=np.uint32))
                    own = np.ones(hashes[-1].size, dtype=np.uint16)
                    own[: len(n) // 2] = np.frombuffer(n, dtype=np.uint16)
                    counts.append(own)
                    if len(hashes) > 64:
                        known, total = summed()
                        hashes, counts = [known], [np.minimum(total, 65535).astype(np.uint16)]
            if part is not None:
                yield done()

        n = min(partitions(df.sparkSession), 1 << bits - cls.BLOCK)
        rows = df.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lean(count), "part int, blocks array<binary>")
        wholes = [bytearray(n << bits - cls.BLOCK) for n in each]
        for r in rows.toLocalIterator():
            for whole, size, block in zip(wholes, each, r["blocks"], strict=True):
                whole[r["part"] * size : (r["part"] + 1) * size] = block
        return wholes

    @classmethod
    def filters(cls, df: DataFrame, limits: tuple[int, ...], bits: int = BITS) -> list[Twofold]:
        """For each limit the filter of the hashes counted that often or more. The first has 2^``bits`` bits on the driver, others 2^27 at most."""
        folds = [0] + [max(0, bits - cls.BITS)] * (len(limits) - 1)

        def form(known: np.ndarray, n: np.ndarray) -> list[bytes]:
            out = []
            for limit, fold in zip(limits, folds, strict=True):
                block = np.zeros(1 << cls.BLOCK - fold, dtype=bool)
                for slot in Twofold.slots(known[n >= limit], fold):
                    block[slot] = True
                out.append(np.packbits(block, bitorder="little").tobytes())
            return out

        maps = cls._maps(df, [1 << cls.BLOCK - f - 3 for f in folds], form, bits)
        return [Twofold(bits, f, m) for f, m in zip(folds, maps, strict=True)]

    @classmethod
    def levels(cls, df: DataFrame) -> Levels:
        """How common every hash is. The driver gets 64 MB."""

        def form(known: np.ndarray, n: np.ndarray) -> list[bytes]:
            block = np.zeros(1 << cls.BLOCK, dtype=np.uint8)
            np.maximum.at(block, known & np.uint32((1 << cls.BLOCK) - 1), np.minimum(np.frexp(n)[1] - 1, 15).astype(np.uint8))
            return [(block[::2] | block[1::2] << 4).tobytes()]

        return Levels(cls.BITS, *cls._maps(df, [1 << cls.BLOCK - 1], form, cls.BITS))


def hash_of_long(x: int) -> int:
    """As Spark's xxhash64 of one long, unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed=42)
