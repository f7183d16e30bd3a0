"""Harmonic packing of token sequences.

A document longer than a sequence is cut into full ones; what is left of it, and every other document, is an item
that fits. Class k holds the items whose length is over C / (k + 1) and at most C / k, and a bin of it takes exactly
k of them, whichever those are: bins need no look at other bins, so every worker packs what it reads by itself, some
thousand documents at a time.

The gap that a class leaves in its bins is filled with items of the shortest classes, as many of these as the gaps
ask for: whole ones while some fit, then one that is cut. Neither part of a cut has fewer than ``LEAST`` tokens; a
gap under that is padded. The last bin of a worker's round is seldom full: these tails are packed by first fit decreasing on
the driver, which knows one length a round.

Edge cases: a null or empty text is one item, the end id; a document of any length is cut; repeated
rows are packed each for itself; null doc_ids are kept; an empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END = 4096, 2
#: No part of a cut is shorter, and no gap that is padded longer.
LEAST = 32
#: Tokens that a worker packs together.
ROUND = 8_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: (item, start in the document, length) in order of offset.
Bin = list[tuple[int, int, int]]


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given longest first; bins by a tree over their free space."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    free = [0] * size + [capacity] * size
    for i in range(size - 1, 0, -1):
        free[i] = max(free[2 * i], free[2 * i + 1])
    out = []
    for n in lengths:
        i = 1
        while i < size:
            i = 2 * i if free[2 * i] >= n else 2 * i + 1
        out.append((i - size, capacity - free[i]))
        free[i] -= n
        while i > 1:
            i //= 2
            free[i] = max(free[2 * i], free[2 * i + 1])
    return out


def _filled(items: Bin, gap: int, loose: list[tuple[int, int, int]], least: int) -> int:
    """Fills a bin's gap from ``loose`` (length, item, start; sorted); returns what stays free."""
    while gap and loose:
        at = bisect_right(loose, (gap, 1 << 62, 0)) - 1
        if at >= 0:
            n, item, start = loose.pop(at)
        else:  # all are longer than the gap
            if gap < least:
                break
            n, item, start = loose.pop()
            cut = min(gap, n - least)
            if cut < least:
                loose.append((n, item, start))
                break
            insort(loose, (n - cut, item, start + cut))
            n = cut
        items.append((item, start, n))
        gap -= n
    return gap


def harmonic(lengths: list[int], capacity: int = CAPACITY, least: int = LEAST) -> tuple[list[Bin], Bin]:
    """Bins of the documents of these lengths, and the bin that is not full."""
    bins: list[Bin] = []
    classes: dict[int, list[tuple[int, int, int]]] = {}
    for i, n in enumerate(lengths):
        whole = n // capacity * capacity
        bins += [[(i, start, capacity)] for start in range(0, whole, capacity)]
        if n > whole:
            classes.setdefault(capacity // (n - whole), []).append((n - whole, i, whole))
    # of class k some multiple of k fills bins; the gaps of the longer classes are to be filled by the shorter
    loose: list[tuple[int, int, int]] = []
    gaps = {k: len(x) // k * capacity - sum(n for n, _, _ in x[: len(x) // k * k]) for k, x in classes.items()}
    over = sum(gaps.values())
    left = sum(n for k, x in classes.items() for n, _, _ in x[len(x) // k * k :])
    for k in sorted(classes, reverse=True):
        x, full = classes[k], len(classes[k]) // k * k
        if left < over:
            left += sum(n for n, _, _ in x[:full])
            over -= gaps[k]
            full = 0
        loose += x[full:]
        classes[k] = x[:full]
    loose.sort()
    for k in sorted(classes):
        x = classes[k]
        for at in range(0, len(x), k):
            one = [(i, start, n) for n, i, start in x[at : at + k]]
            _filled(one, capacity - sum(n for _, _, n in one), loose, least)
            bins.append(one)
    tail: Bin = []
    while loose:
        tail = []
        if _filled(tail, capacity, loose, least) < least or loose:
            bins.append(tail)
            tail = []
    return bins, tail


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces, each with the CRC-32 of its ids as little-endian uint32, and its place:
    the round it was packed in, the bin there (null: the tail) and the offset."""
    most, least = ROUND, LEAST

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = tokens.encoder(tokenizer), end.to_bytes(4, "little")
        part, number = TaskContext.get().partitionId() << 32, 0
        ids, datas, size = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            bins, tail = harmonic([len(d) // 4 for d in datas], capacity, least)
            rows = []
            for k, one in [*enumerate(bins), (None, tail)]:
                offset = 0
                for i, start, n in one:
                    data = datas[i]
                    rows.append((ids[i], start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4, part + number, k, offset))
                    offset += n
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 20_000], strict=True)], [f.split()[0] for f in f"{SCHEMA}, round _, bin _, offset _".split(", ")])

        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, upto in tokens.slices(texts):
                for doc, data in zip(docs[at:upto], coder.encode([t or "" for t in texts[at:upto]]), strict=True):
                    ids.append(doc)
                    datas.append(data + last)
                    size += len(data) // 4 + 1
                if size > most:
                    yield from done()
                    ids, datas, size = [], [], 0
                    number += 1
        if ids:
            yield from done()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(common.lean(pack, "tokens"), f"{SCHEMA}, round long, bin long, offset long")


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (of ``pieces``; read twice, so stored) with sequence_id and offset over all rounds."""
    spark = parts.sparkSession
    # a row for each round, which has millions of tokens
    rounds = parts.groupBy("round").agg((F.coalesce(F.max("bin"), F.lit(-1)) + 1).alias("bins"), F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("length"))), F.lit(0)).alias("tail")).collect()
    rounds.sort()
    first, begin = {}, 0
    for r in rounds:
        first[r["round"]] = begin
        begin += r["bins"]
    tails = sorted((r for r in rounds if r["tail"]), key=lambda r: (-r["tail"], r["round"]))
    place = {r["round"]: (begin + b, o) for r, (b, o) in zip(tails, first_fit([r["tail"] for r in tails], capacity), strict=True)}
    at = spark.createDataFrame([(k, v, *place.get(k, (0, 0))) for k, v in first.items()], "round long, first long, tail long, before long")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    inside = F.col("bin").isNotNull()
    return parts.join(at, "round").select(*names, F.when(inside, F.col("first") + F.col("bin")).otherwise(F.col("tail")).alias("sequence_id"), F.when(inside, F.col("offset")).otherwise(F.col("before") + F.col("offset")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return packed(common.stored(pieces(docs, tokenizer or tokens.default_path(), capacity, end), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 4096 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
