"""A content-addressed store of token-id streams.

Format, all files written by Spark as Parquet below one folder:

``staged/kind=0/``  chunks: key (BLAKE2b-128 of the ids as little-endian uint32), n (ids), payload
              (the ids in 2 bytes each, or 4 if the vocabulary needs it); each different chunk once, in the order of its hash.
``staged/kind=1/``  the documents' recipes as tasks made them, in no order.
``recipes/``  documents in ascending doc_id order, file by file and row by row: doc_id, start (ids of
              all documents before it), n_tokens, chunks (their hashes in order), counts (ids of
              each), root (the Merkle root of the hashes).
``manifest/`` a row for each range of doc_ids: documents, ids, and the Merkle root of their roots; reading holds the recipes against it.

A document's stream is cut where the low bits of a gear hash, which rolls over the last ``BITS`` ids,
are zero, so an edit moves only the cuts near it; chunks have ``LEAST`` to ``MOST`` ids (the last of a document
may be shorter).

A task sends a chunk once, however many of its documents hold it, so a text with many copies meets
in one place only as often as there are tasks. Reading checks every chunk against its address and
every document against its root.

Edge cases: a null or empty text is a stream of the end id alone; repeated rows of a doc_id follow each
other (ordered by root); null doc_ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END, BITS, LEAST, MOST = 1, 9, 128, 4096


_gear: list[np.ndarray] = []


def gear(n: int) -> np.ndarray:
    """A fixed random number for each id below ``n``."""
    if not _gear or _gear[0].size < n:
        _gear[:] = [common.mixed(np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)]
    return _gear[0]


def batch_ends(ids: np.ndarray, sizes: list[int], bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Where the chunks of consecutive streams end, counted from each stream's start.

    The hash rolls on from one stream to the next; since ``least`` exceeds its ``bits`` ids, that moves no cut.
    """
    mask = np.uint32((1 << bits) - 1)
    own = gear(int(ids.max()) + 1 if ids.size else 1)[ids]
    rolled = own.copy()
    for j in range(1, bits):
        rolled[j:] += own[:-j] << np.uint32(j)
    cuts = np.flatnonzero((rolled & mask) == 0) + 1
    ends = np.cumsum(sizes)
    where = np.searchsorted(cuts, ends, side="left")
    cuts = cuts.tolist()
    out, begin, k = [], 0, 0
    for end, to in zip(ends.tolist(), where.tolist(), strict=True):
        found, at = [], begin
        for c in [*cuts[k:to], end]:
            while c - at > most:
                at += most
                found.append(at - begin)
            if c - at >= least or c == end:
                if c > at:
                    found.append(c - begin)
                at = c
        out.append(found)
        begin, k = end, to
    return out


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where the chunks of one stream end."""
    return batch_ends(ids, [ids.size])[0]


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over ``leaves``; an odd node moves up as it is."""
    if not leaves:
        return bytes(16)
    level = leaves
    while len(level) > 1:
        up = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) // 2 * 2 :]
    return level[0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, key, doc, n, payload, chunks, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()), pa.array(chunks, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
        ["kind", "key", "doc_id", "n", "payload", "chunks", "counts"],
    )


_SCHEMA = "kind int, key binary, doc_id long, n long, payload binary, chunks array<binary>, counts array<bigint>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store at ``path``, a folder all executors share."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = tokens.encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        width = "<u2" if max(coder.vocab_size, end + 1) <= 1 << 16 else "<u4"
        size, sent = int(width[-1]), set()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, upto in tokens.slices(texts):
                rows = []
                datas = [d + last for d in coder.encode([t or "" for t in texts[at:upto]])]
                stream = np.frombuffer(b"".join(datas), dtype="<u4")
                narrow, origin = stream.astype(width).tobytes(), 0
                for doc, data, ends in zip(ids[at:upto], datas, batch_ends(stream, [len(d) // 4 for d in datas]), strict=True):
                    begin, chunks, counts = 0, [], []
                    for to in ends:
                        key = address(data[4 * begin : 4 * to])
                        chunks.append(key)
                        counts.append(to - begin)
                        if key not in sent:
                            if len(sent) > 1_000_000:
                                sent.clear()
                            sent.add(key)
                            rows.append((0, key, None, to - begin, narrow[size * (origin + begin) : size * (origin + to)], None, None))
                        begin = to
                    rows.append((1, merkle(chunks), doc, len(data) // 4, None, chunks, counts))
                    origin += len(data) // 4
                yield _batch(rows)

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(encode, "tokens"), _SCHEMA)
    sent = sent.withColumn("_deal", F.when(F.col("kind") == 0, F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key")))
    staged = f"{path}/staged"
    # tasks that hold one chunk each send it: one of them is kept; documents all stay
    alike = Window.partitionBy("kind", "_deal", "key").orderBy("kind")
    once = sent.repartition(common.partitions(spark), "_deal").withColumn("_again", F.row_number().over(alike)).where("kind = 1 or _again = 1").drop("_deal", "_again")
    once.write.partitionBy("kind").option("compression", "snappy").parquet(staged)
    # recipes hold no ids: small, they are ordered and numbered apart
    recipes = spark.read.schema(_SCHEMA).parquet(staged).where("kind = 1").select("doc_id", F.col("key").alias("root"), F.col("n").alias("n_tokens"), "chunks", "counts")
    recipes = common.with_starts(recipes, "doc_id", "n_tokens", "start", ("root",))
    bounds = common.bounds_of(recipes, "doc_id", min(1024, common.partitions(spark)))
    recipes.withColumn("range", common.bucket_of(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("doc_id", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")

    _roots(spark, path).write.parquet(f"{path}/manifest")


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, made from the recipes: range, documents, ids, root."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, leaves, n = None, [], 0
        line = lambda: pa.RecordBatch.from_pydict({"range": pa.array([part], pa.int32()), "documents": [len(leaves)], "ids": [n], "root": [merkle(leaves)]})
        for b in batches:
            for p, root, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part and leaves:
                    yield line()
                    leaves, n = [], 0
                part = p
                leaves.append(root)
                n += k
        if leaves:
            yield line()

    recipes = spark.read.parquet(f"{path}/recipes").select("range", "root", "n_tokens", "doc_id").repartition(common.partitions(spark), "range").sortWithinPartitions("range", "doc_id", "root")
    return recipes.select("range", "root", "n_tokens").mapInArrow(common.lean(roots), "range int, documents long, ids long, root binary")


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a recipe was changed, lost or added since the manifest was written."""
    names = ["range", "documents", "ids", "root"]
    said = spark.read.schema("range int, documents long, ids long, root binary").parquet(f"{path}/manifest").select(*names)
    now = _roots(spark, path).select(*names)
    wrong = said.withColumn("n", F.lit(1)).unionByName(now.withColumn("n", F.lit(-1))).groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0").select("range").take(1)
    if wrong:
        raise ValueError(f"the recipes of range {wrong[0]['range']} differ from the manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored chunks: hash, n_ids, payload; each payload as it is on disk."""
    return spark.read.schema(_SCHEMA).parquet(f"{path}/staged").where("kind = 0").select(F.col("key").alias("hash"), F.col("n").alias("n_ids"), "payload")


def _ids(payload: bytes, n: int, key: bytes) -> bytes:
    ids = np.frombuffer(payload, dtype="<u2" if len(payload) == 2 * n else "<u4").astype("<u4").tobytes()
    if len(ids) != 4 * n or address(ids) != key:
        raise ValueError(f"chunk {key.hex()} does not hold what its address says")
    return ids


def _refs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("at", "hash"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Each chunk is read, decoded and checked against its address where it lies; only its CRC-32 and length
    travel to the documents that hold it, where they are joined in order (the CRC of a whole follows from its parts')
    and checked against the Merkle root. The recipes themselves are held against the manifest first.
    """
    verify(spark, path)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, crc = b.column(0).to_pylist(), []
            for key, n, payload in zip(keys, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                crc.append(zlib.crc32(_ids(payload, n, key)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crc, pa.int64())], ["hash", "n_ids", "crc"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for doc, n, root, parts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if merkle([p["hash"] for p in parts]) != root or sum(p["n_ids"] for p in parts) != n:
                    raise ValueError(f"document {doc} differs from its recipe")
                crc.append(common.crc_joined([(p["crc"], 4 * p["n_ids"]) for p in parts]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    read = chunks(spark, path).mapInArrow(common.lean(check), "hash binary, n_ids long, crc long")
    parts = _refs(spark, path).join(read, "hash", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "n_ids", "crc"))).alias("parts"))
    return parts.mapInArrow(common.lean(whole), "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together again from its chunks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, root, parts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                data = b"".join(_ids(p["payload"], p["n_ids"], p["hash"]) for p in parts)
                if merkle([p["hash"] for p in parts]) != root or len(data) != 4 * n:
                    raise ValueError(f"document {doc} differs from its recipe")
                out.append(np.frombuffer(data, dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    parts = _refs(spark, path).join(chunks(spark, path), "hash", "left").groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "n_ids", "payload"))).alias("parts"))
    return parts.mapInArrow(common.lean(join), "doc_id long, start long, ids array<int>")


def op4_chunkstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids to a store and reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = common.scratch(spark, "chunkstore")
    write(common.table(spark, sf_dir, "documents"), path, tokens.default_path())
    return digests(spark, path)
