"""Exact Jaccard join of documents by their word shingles: T-occurrence search with DivideSkip.

A document's set is its distinct shingles of ``WORDS`` words (the whole sequence, if it is shorter).
Two link when their Jaccard similarity is 0.75 or more, which needs an overlap of
T = ceil(3/7 (|x| + |y|)). The result is every document's component under all links.

Candidates. Shingles have one total order: by how common they are, in powers of two, then by hash (how common
is read from a table of fixed size, made from a count over the whole corpus; as an order it may
be any numbers). By the prefix principle linked sets share a shingle among their first |x| - ceil(3/4 |x|) + 1,
so only those, and of them only the ones that another document has, become postings. A shingle that no other
document has comes first and takes its place in the prefix for nothing, so texts just under the
similarity have few postings. Putting the long lists last is DivideSkip's division: a set with fewer than T
frequent shingles never enters a long list.

Round 1 checks each document against one pivot: the first document of most of its lists. Components of
those links collapse groups of copies. Round 2 looks only across components: in each list that more
than one component has, the documents outside its largest one are set against the rest, and pairs go on whose
number of common postings can still reach T (a prefix shingle that the other prefix lacks is a miss; so is one
that no other document has), and whose parities, a few bits of each set, do not differ in more places than
the sizes allow. Together the two
rounds see every pair that could join two components, so no link that matters is lost, while a group of
copies costs its size, not its square.

Checking. A pivot's sets are searched in blocks: the block's inverted lists are split into the L longest
and the rest, the short lists are heap-merged, documents with at least T - L occurrences are probed for in the
long lists by binary search, and those that reach T stay.

Edge cases: null or empty texts have no shingle and link with nothing; equal texts link; rows that
share a doc_id are one node, each with its own n_shingles; null doc_ids get a null component; an empty
table gives no row; other columns are passed by or kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: Shingles of this many documents or more are alike in the order.
FREQUENT = 1 << 15
#: 64-bit words of a set's parities.
PARITIES = 8
#: Sets that one block of a search holds.
BLOCK = 256

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def required(x: int, y: int) -> int:
    """The least overlap with which sets of these sizes have 100 * intersection >= 75 * union."""
    return -(-3 * (x + y) // 7)


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes. A-Z are lowered; words end at ASCII white space."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    blank = _BLANK[data]
    inside = ~blank
    begin = np.flatnonzero(inside & np.r_[True, blank[:-1]])
    end = np.flatnonzero(inside & np.r_[blank[1:], True]) + 1
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    if not begin.size:
        return out
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, data.size), dtype=np.uint64)]
        word = common.mixed((sums[end] - sums[begin]) * _powers(_P_INVERSE, data.size)[begin] + (end - begin).astype(np.uint64))
        doc = np.searchsorted(np.cumsum(sizes), begin, side="right")
        m = max(0, word.size - k + 1)
        h = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            h = h * _P_INVERSE + word[j : j + m]
        h = common.mixed(h + np.uint64(k))
        whole = doc[:m] == doc[k - 1 : k - 1 + m]
        h, of = h[whole], doc[:m][whole]
        count = np.bincount(doc, minlength=len(texts))
        firsts = np.searchsorted(doc, np.arange(len(texts)))
        short = np.flatnonzero((count > 0) & (count < k))
        extra = np.zeros(short.size, dtype=np.uint64)
        for i, d in enumerate(short):
            x = np.zeros(1, dtype=np.uint64)
            for w in word[firsts[d] : firsts[d] + count[d]]:
                x = x * _P_INVERSE + w
            extra[i] = common.mixed(x + np.uint64(count[d]))[0]
    h, of = np.r_[h, extra], np.r_[of, short]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if h.size else np.zeros(0, dtype=bool)
    h, of = h[new], of[new]
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _candidates(s: np.ndarray, levels: common.Levels, most: int) -> tuple[np.ndarray, int]:
    """Those of a sorted set's prefix in the total order that other sets may have; how many of the whole set others may have."""
    if not s.size:
        return s, 0
    level = np.minimum(levels.of(s), most)
    first = np.argsort(level, kind="stable")[: prefix(s.size)]
    return s[first[level[first] > 0]], int(np.count_nonzero(level))


def parities(s: np.ndarray) -> np.ndarray:
    """Of each of 64 ``PARITIES`` groups of hashes, whether the set has an odd number.

    Where two sets' parities differ, some shingle is in one alone: so many shingles at least differ.
    """
    odd = np.bincount((s >> np.uint64(32) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """(ids, sets) of a few documents at a time: of ``size`` bytes, or of one longer one."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = min(b.num_rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1)
            some = b.slice(at, to - at)
            yield some.column(0).to_pylist(), shingle_sets(some.column(1).to_pylist())
            at = to


def _census(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = common.Census()
        for _, sets in _batches(batches):
            if sets:
                yield from held.add(np.concatenate(sets))
        yield from held.flush()

    return docs.mapInArrow(common.lean(count), common.Census.SCHEMA)


def _postings(docs: DataFrame, levels, frequent: int) -> DataFrame:
    """(shingle, doc, size, live, place) of shared prefix shingles, and a row without shingle, with parities, for every document.

    ``live``: how many shingles of the set others may have; ``place``: how many of them come before this one.
    """
    most = max(1, frequent.bit_length() - 1)
    words = [f"odd{i}" for i in range(PARITIES)]
    names = ["shingle", "doc", "size", "live", "place", *words]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches):
            found = [_candidates(s if i is not None else s[:0], levels.value, most) for i, s in zip(ids, sets, strict=True)]
            n = np.array([x.size for x, _ in found])
            doc = pa.array(ids, pa.int64())
            sizes, live = np.array([s.size for s in sets], dtype=np.int32), np.array([x for _, x in found], dtype=np.int32)
            odd = np.array([parities(x) for x in sets], dtype=np.int64).reshape(-1, PARITIES).T
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), doc, pa.array(sizes), pa.array(live), pa.nulls(len(ids), pa.int32()), *map(pa.array, odd)], names)
            if n.sum():
                at = np.repeat(np.arange(len(ids)), n)
                place = np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
                shingles = np.concatenate([x for x, _ in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingles), doc.take(pa.array(at)), pa.array(sizes[at]), pa.array(live[at]), pa.array(place.astype(np.int32)), *[pa.nulls(at.size, pa.int64()) for _ in words]], names)

    return docs.mapInArrow(common.lean(emit), ", ".join(["shingle long, doc long, size int, live int, place int", *[f"{w} long" for w in words]]))


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], mu: float = 0.01) -> list[int]:
    """Which of ``sets`` overlap ``query`` as much as their sizes require, by DivideSkip."""
    need = [required(query.size, s.size) for s in sets]
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    a, b = np.searchsorted(tokens, query), np.searchsorted(tokens, query, side="right")
    lists = sorted((owner[x:y].tolist() for x, y in zip(a.tolist(), b.tolist(), strict=True) if y > x), key=len)
    if not lists:
        return []
    t = min(need)
    skip = min(t - 1, int(t / (mu * np.log2(max(2, len(lists[-1]))) + 1)) if len(sets) > 8 else 0, len(lists))
    short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
    found = []
    for doc, hits in groupby(heapq.merge(*short)):
        n = sum(1 for _ in hits)
        if n >= need[doc] - skip:
            left = len(long)
            for one in long:
                if n + left < need[doc]:
                    break
                left -= 1
                i = bisect_left(one, doc)
                n += i < len(one) and one[i] == doc
            if n >= need[doc]:
                found.append(doc)
    return found


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (pivot, doc: long) whose sets link, as (a, b). Sets are made anew from the documents that occur."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("doc").alias("id")).unionByName(pairs.select(F.col("pivot").alias("id"))).distinct()
    held = spark.sparkContext.broadcast(common.BitFilter.build(wanted.select(F.xxhash64("id").alias("h")), "h", 24))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.array([0 if i is None else common.hash_of_long(i) for i in b.column(0).to_pylist()], dtype=np.uint64)
            keep = held.value.has(known) & np.array([i is not None for i in b.column(0).to_pylist()], dtype=bool) if known.size else known.astype(bool)
            for ids, sets in _batches(iter([b.filter(pa.array(keep))])):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    sets = common.stored(docs.mapInArrow(common.lean(emit), "id long, set binary").join(wanted, "id", "left_semi"), "shingle-sets")
    # a pivot's documents are dealt to as many tasks as they fill blocks
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    members = pairs.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("doc"), "n").alias("salt"), "doc").join(sets.withColumnRenamed("id", "doc"), "doc").select("pivot", "salt", "doc", "set")
    heads = salts.join(sets.withColumnRenamed("id", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), F.lit(None).cast("long").alias("doc"), "set")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, ids, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            hit = sorted({i for q in queries for i in t_occurrence(q, sets)})
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(hit), pa.int64()), pa.array([ids[i] for i in hit], pa.int64())], ["a", "b"])

        for b in batches:
            for pivot, salt, doc, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (pivot, salt) != group:
                    if ids:
                        yield done()
                    group, queries, ids, sets = (pivot, salt), [], [], []
                s = np.frombuffer(data, dtype=np.uint64)
                if not s.size:
                    continue
                if doc is None:
                    queries.append(s)
                    continue
                ids.append(doc)
                sets.append(s)
                if len(ids) >= 2 * BLOCK:
                    yield done()
                    ids, sets = [], []
        if ids:
            yield done()

    both = members.unionByName(heads).repartition(common.partitions(spark), "pivot", "salt").sortWithinPartitions("pivot", "salt", F.asc_nulls_first("doc"))
    links = common.stored(both.mapInArrow(common.lean(search), "a long, b long"), "shingle-links")
    common.dropped(sets)
    return links


def _needed(x: Column, y: Column) -> Column:
    return F.ceil(3 * (x + y) / 7 - F.lit(1e-9))


def _fits(x: str, y: str) -> Column:
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def classes(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    # every plan with Python has run when this returns
    with common.small_batches(docs.sparkSession):
        return _classes(docs, text, frequent)


def _classes(docs: DataFrame, text: str, frequent: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(common.Census.levels(_census(rows)))
    all_rows = common.stored(_postings(rows, levels, frequent), "shingle-postings")
    words = [f"odd{i}" for i in range(PARITIES)]
    posts = all_rows.where("shingle is not null").drop(*words)

    lists = posts.groupBy("shingle").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    posts = common.stored(posts.join(lists, "shingle"), "shingle-lists")
    heads = posts.groupBy("doc").agg(F.max("size").alias("pivot_size"), F.max("live").alias("pivot_live")).withColumnRenamed("doc", "pivot")
    votes = posts.where("doc <> pivot").groupBy("doc", "size", "live", "pivot").agg(F.count("*").alias("n"))
    votes = votes.join(heads, "pivot").where(_fits("size", "pivot_size") & (F.least("live", "pivot_live") >= _needed(F.col("size"), F.col("pivot_size"))))
    best = common.stored(votes.groupBy("doc").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot")), "shingle-pairs")
    links = _linked(rows, best)
    common.dropped(best)

    first = common.components(links)
    first = common.stored(first, "shingle-first")
    named = posts.join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    counts = named.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    split = counts.groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("root", F.struct("n", "root")).alias("top")).where("k > 1").drop("k")
    named = common.stored(named.join(split, "shingle"), "shingle-split")
    common.dropped(posts)
    # a pair needs as many common postings as its sizes ask for, so neither side may have fewer in all
    held = named.groupBy("doc").agg(F.count("*").alias("held"))
    # rows that share a doc_id have no parities in common
    odd = all_rows.where("shingle is null").groupBy("doc").agg(*[F.when(F.count("*") == 1, F.max(w)).alias(w) for w in words])
    named = named.join(held.join(odd, "doc"), "doc")
    own = [F.col("doc"), F.col("size"), F.col("root"), F.col("held"), F.col("place"), F.col("live") - F.col("place")]
    x = named.where("root <> top").select("shingle", *[c.alias(n) for c, n in zip(own, ("x", "m", "p", "i", "x_before", "x_after"), strict=True)], *[F.col(w).alias(f"x_{w}") for w in words])
    y = named.select("shingle", *[c.alias(n) for c, n in zip(own, ("y", "n", "q", "j", "y_before", "y_after"), strict=True)], *[F.col(w).alias(f"y_{w}") for w in words], "top")
    need = _needed(F.col("m"), F.col("n"))
    reach = need - F.ceil(3 * F.greatest("m", "n") / 4) + 1
    # what two sets share comes before this shingle in both or from it on in both
    room = F.least("x_before", "y_before") + F.least("x_after", "y_after") >= need
    apart = sum(F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words)
    room &= F.coalesce(apart, F.lit(0)) <= F.col("m") + F.col("n") - 2 * need
    # of two documents that are both outside the largest component, the pair is met from the smaller id alone
    met = x.join(y, "shingle").where((F.col("p") != F.col("q")) & ((F.col("q") == F.col("top")) | (F.col("x") < F.col("y"))) & _fits("m", "n") & (F.least("i", "j") >= reach) & room)
    # lists differ in their largest component, so a pair may be met from either side
    turned = F.col("x") > F.col("y")
    pair = [F.least("x", "y").alias("pivot"), F.greatest("x", "y").alias("doc"), F.when(turned, F.col("n")).otherwise(F.col("m")).alias("m"), F.when(turned, F.col("m")).otherwise(F.col("n")).alias("n")]
    met = met.groupBy(*pair).agg(F.count("*").alias("c"))
    rest = common.stored(met.where(F.col("c") >= reach).select("pivot", "doc").distinct(), "shingle-pairs")
    more = _linked(rows, rest)
    common.dropped(rest)

    roots = common.components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    sizes = all_rows.where("shingle is null").select(F.col("doc").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"))
    return sizes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the smallest doc_id that links reach from it."""
    return classes(common.table(spark, sf_dir, "documents"))


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """The definition on word tuples, pair by pair, for tests: doc_id -> (n_shingles, component_id)."""
    sets = {}
    for doc, t in docs:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[doc] = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)} if len(w) >= WORDS else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}
