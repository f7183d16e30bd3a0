"""Document fingerprints by I-Match with randomised lexicons.

Terms are lower-cased words of letters and digits. The lexicon keeps those in a band of inverse
document frequency: in at least ``RAREST`` and at most ``COMMONEST`` of all documents. Its size has a bound that no corpus size
moves: terms in at least a share p of documents number at most (mean terms of a document) / p.

``LEXICONS`` random sub-lexicons are drawn at every level l: each keeps a term with probability
2^-l, by a hash of the term, so a term kept at one level is kept at all below. A text with n
terms in the band is hashed from a base level near log2 n upwards, where a sub-lexicon holds one or two of its
terms: for each sub-lexicon, its distinct terms there are sorted and hashed in order, until no sub-lexicon holds
one. Levels above hold none, so any two texts have all levels from the higher of their base levels in common.

Two texts agree in a sub-lexicon from just above the highest level of a term that only one of them has, and both have no term
there from just above the highest level of a term that both have. The highest level of N terms is below l with probability
(1 - 2^-l)^N; with the texts' numbers of terms, which are in the print, these levels give the likelihood of every number
in common, and the likeness is 2 x the likeliest of those / the sum of the numbers: the share of their terms that the two have in common.

A text without terms in the band is fingerprinted by a hash of all its words; two such are alike (1) if equal, else 0.
Edge cases: null is the empty text, which has a fingerprint of its own; repeated doc_ids are ordered
by text; null doc_ids come last; a single document's next is itself; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RAREST, COMMONEST, LEXICONS, SEED = 0.001, 0.2, 40, 11
_TERMS = re.compile(r"[^\W_]+")
_TOP = 24  # levels
_GRID = 65  # numbers of terms in common that are tried

#: Base levels, numbers of terms, hashes by level and lexicon.
Prints = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: str) -> list[str]:
    return _TERMS.findall(text.lower())


def _hash(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Lexicon:
    """The terms in the band, in order, and at which levels each random sub-lexicon keeps them."""

    def __init__(self, terms: list[str], lexicons: int = LEXICONS, seed: int = SEED):
        self.at = {t: i for i, t in enumerate(sorted(terms))}
        self.hash = np.fromiter((_hash(t) for t in self.at), dtype=np.uint64, count=len(self.at))
        seeds = common.mixed(np.arange(1, lexicons + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        bits = common.mixed(self.hash[:, None] ^ seeds[None, :])
        low = bits & (~bits + np.uint64(1))
        self.level = np.minimum(np.where(bits == 0, _TOP, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))), _TOP).astype(np.int8)
        self.lexicons = lexicons

    def prints(self, texts: list[str]) -> Prints:
        """For each text its base level (-1: no term in the band), its number of terms there, and lexicons hashes (0: no term)
        for each level from the base; without terms the first is of all words."""
        n, r = len(texts), self.lexicons
        base, levels = np.full(n, -1, dtype=np.int64), [np.zeros((n, r), dtype=np.uint64)]
        found, sizes = [], np.zeros(n, dtype=np.int64)
        get = self.at.get
        for i, t in enumerate(texts):
            words = terms_of(t)
            at = {get(w) for w in set(words)}
            at.discard(None)
            if at:
                found.extend(sorted(at))  # terms in order
                sizes[i] = len(at)
            else:
                levels[0][i, 0] = _hash(" ".join(words) or t) | 1
        if found:
            term, doc = np.array(found), np.repeat(np.arange(n), sizes)
            has = sizes > 0
            base[has] = np.clip(np.ceil(np.log2(sizes[has])) - 1, 0, _TOP - 2).astype(np.int64)
            above = self.level[term] - base[doc].astype(np.int8)[:, None]
            row, lex = np.nonzero(above >= 0)
            above, key = above[row, lex], doc[row] * r + lex
            order = np.argsort(key, kind="stable")
            above, key, own = above[order], key[order], self.hash[term[row[order]]]
            while key.size:
                begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                rank = np.arange(key.size) - np.repeat(begins, np.diff(np.r_[begins, key.size]))
                with np.errstate(over="ignore"):
                    part = common.mixed(own + (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                    levels[-1].reshape(-1)[key[begins]] = common.mixed(np.add.reduceat(part, begins)) | np.uint64(1)
                some = above >= len(levels)
                above, key, own = above[some], key[some], own[some]
                if key.size:
                    levels.append(np.zeros((n, r), dtype=np.uint64))
        return base, sizes, np.stack(levels, axis=1)

    @staticmethod
    def likeness(a: Prints, b: Prints) -> np.ndarray:
        """Of each print in ``a`` to the one in its place in ``b``."""
        (la, na, ha), (lb, nb, hb) = a, b
        deep, r = max(ha.shape[1], hb.shape[1]), ha.shape[2]
        low = np.maximum(np.maximum(la, lb), 0)  # the lowest level that both have

        def held(base: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            at = (low - base)[:, None] + np.arange(deep)
            some = hashes[np.arange(base.size)[:, None], np.minimum(at, hashes.shape[1] - 1)]
            return np.where((at < hashes.shape[1])[:, :, None], some, np.uint64(0))

        x, y = held(la, ha), held(lb, hb)
        # levels from ``low`` with a term of one text alone, and those above with terms of both alone
        apart = (x != y).sum(1)
        same = ((x == y) & (x != 0)).sum(1)

        def tally(of: np.ndarray, which: np.ndarray) -> np.ndarray:
            """By row and level from ``low``, in how many lexicons of ``which`` it is ``of``."""
            at = np.arange(of.shape[0])[:, None] * (deep + 1) + of
            return np.bincount(at[which], minlength=of.shape[0] * (deep + 1)).reshape(-1, deep + 1)

        every = np.ones_like(apart, dtype=bool)
        ends = [tally(apart, every), tally(apart + same, same > 0), tally(apart, same == 0)]
        level = low[:, None] + np.arange(deep + 1)
        with np.errstate(divide="ignore"):
            below = np.where(level > _TOP, 0.0, np.maximum(np.log1p(-(0.5**level)), -1e9))
        less = np.c_[np.full(low.size, -1e9), below[:, :-1]]
        fewer = np.minimum(na, nb)
        shared = np.rint(np.linspace(0, 1, _GRID)[None, :] * fewer[:, None])
        alone = (na + nb)[:, None] - 2 * shared

        def highest(number: np.ndarray, known: np.ndarray, bound: np.ndarray) -> np.ndarray:
            """The log likelihood of each ``number`` of terms if their highest level is one less than that of ``known``, or below that of ``bound``."""
            out = np.zeros_like(number)
            for k in range(deep + 1):
                if known[:, k].any():
                    gap = -np.expm1(np.maximum(number * (less[:, k] - below[:, k])[:, None], -700))
                    out += known[:, k, None] * (number * below[:, k, None] + np.log(np.maximum(gap, 1e-300)))
                if bound[:, k].any():
                    out += bound[:, k, None] * number * below[:, k, None]
            return out

        none = np.zeros_like(ends[0])
        none[:, 0] = ends[0][:, 0]
        ends[0][:, 0] = 0
        likely = highest(alone, ends[0], none) + highest(shared, ends[1], ends[2])
        best = np.take_along_axis(shared, likely.argmax(1)[:, None], 1)[:, 0]
        out = np.where((la >= 0) & (lb >= 0), 2 * best / np.maximum(na + nb, 1), 0.0)
        equal = (la == lb) & (na == nb) & (x == y).all(axis=(1, 2))
        return np.where(equal, 1.0, out)

    @staticmethod
    def text(prints: Prints) -> list[str]:
        """Base level, number of terms, and for each lexicon its hashes from the base up: a dot for one equal to that below, none after the last."""
        out = []
        for b, n, full in zip(prints[0].tolist(), prints[1].tolist(), prints[2], strict=True):
            if b < 0:
                out.append(f"w:{int(full[0, 0]):016x}")
                continue
            said = []
            for chain in full.T.tolist():
                part, last = "", 0
                for h in chain:
                    if not h:
                        break
                    part += "." if h == last else f"{h >> 40:06x}"
                    last = h
                said.append(part or "-")
            out.append(f"{b:02d}:{n}:" + ",".join(said))
        return out


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many rows of ``docs`` each term is. Tasks sum their terms before they are dealt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        flush = lambda: pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "df": pa.array(seen.values(), pa.int64())})
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in set(terms_of(t)):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return docs.select(common.text_of(docs, text)).mapInArrow(common.lean(count), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> Lexicon:
    """The band's terms, at most (mean terms of a document) / ``rarest`` of them."""
    n = docs.count()
    band = document_frequencies(docs, text).where((F.col("df") >= rarest * n) & (F.col("df") <= max(1.0, commonest * n)))
    return Lexicon([r["term"] for r in band.select("term").toLocalIterator()])


def fingerprints(docs: DataFrame, words: Lexicon, text: str = "text", into: str = "_fingerprint") -> DataFrame:
    """``docs`` with a column ``into`` (which replaces one of that name); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    columns = [c for c in docs.columns if c != into]
    docs = docs.select(*[F.col(common.quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    names, at = docs.columns, columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                texts = [t or "" for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(Lexicon.text(shared.value.prints(texts)), pa.string())], [*names, "print"])

    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField("print", T.StringType())])
    return docs.mapInArrow(common.lean(add), out).toDF(*columns, into)


def in_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, extra) dealt to partitions by descending doc_id and sorted in them.

    The first document of each partition comes again, with ``extra``, at the end of the one before, and
    the very first at the end of the last: every row but those finds its next one below it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(docs, text).alias("text"))
    about = rows.agg(F.max("doc_id").alias("top"), F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).first()
    n = common.partitions(spark, about["size"] or 0)
    bounds = common.bounds_of(rows, "doc_id", n)
    last = len(bounds)
    # bucket 0 takes the largest ids; null ids go to the last
    where = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(last) - common.bucket_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("_bucket", where.cast("int"))
    # the largest id of a bucket is what the bucket before needs: an aggregate of ids, one row a bucket
    tops = {r["_bucket"]: r["top"] for r in rows.groupBy("_bucket").agg(F.max("doc_id").alias("top")).collect()}
    filled = sorted(tops)
    to = {}  # id -> the buckets at whose end it comes again
    for i, b in enumerate(filled):
        to.setdefault(tops[filled[(i + 1) % len(filled)]], []).append(b)
    heads = spark.createDataFrame([(k, b) for k, v in to.items() for b in v], "_head long, _to int")
    # several rows may have that id; the first in order is enough, and rows after it are skipped by the reader
    again = rows.join(F.broadcast(heads), rows["doc_id"].eqNullSafe(heads["_head"])).select("doc_id", "text", F.col("_to").alias("_bucket"), F.lit(True).alias("extra"))
    every = rows.select("doc_id", "text", "_bucket", F.lit(False).alias("extra")).unionByName(again)
    return every.repartitionById(last + 1, F.col("_bucket")).sortWithinPartitions(F.asc("extra"), F.desc_nulls_last("doc_id"), F.asc("text")).select("doc_id", "text", "extra")


OP1_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last third replaced by the next document's first."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(lexicon(docs))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
        for b in batches:
            for doc, text, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield doc, text
                if extra:
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Lexicon = shared.value
        held: list[tuple[int | None, str]] = []
        size = 0

        def done(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:], strict=False)]
            own, new = words.prints(texts), words.prints(edited)
            mine, following = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
            said = Lexicon.text(mine)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows[:-1]], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                    pa.array(said),
                    pa.array(Lexicon.text(new)),
                    pa.array(Lexicon.likeness(mine, new), pa.float64()),
                    pa.array(Lexicon.likeness(mine, following), pa.float64()),
                ],
                [x.split()[0] for x in OP1_SCHEMA.split(", ")],
            )

        for row in rows_of(batches):
            held.append(row)
            size += len(row[1])
            if len(held) > 1 and (len(held) > 400 or size > 2_000_000):
                yield done(held)
                held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield done(held)

    return in_ranges(docs).mapInArrow(common.lean(run), OP1_SCHEMA)
