"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words (runs of letters) and their first 4, 5 and 6
letters, so inflected and compounded insults share a term with their stem. A term is known by 62 bits of
its hash. The machine is a bias, a weight a term, and a vector of ``RANK`` numbers a term whose inner
products weigh pairs of terms (an insult next to a group's name); both are learned together.

Bounds, all documented parameters: ``SAMPLE`` labelled rows are fitted on (the smallest by a hash of
doc_id, so any input size draws alike), ``FEATURES`` terms are kept (those that tell the classes
apart most surely, counted over the whole sample). The model is thus of fixed size. Scores cover
every row, without a shuffle.

Edge cases: null and empty texts have no term and score the bias; null doc_ids are scored, are never
held out and never fitted on; null labels are not fitted on; repeated label rows of a document count
once (toxic if any says so); without labels, or with labels of one class, the score is the smoothed
share of toxic rows (a quarter without any). Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE, FEATURES, RANK, LEAST_DF = 50_000, 8_192, 8, 5

_WORDS = re.compile(r"[^\W\d_]+")
#: Words remembered by a worker with their terms.
_MOST = 300_000


def _hash(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


def terms_of(word: str) -> tuple[int, ...]:
    return (_hash(word), *(_hash(f"{word[:n]}*{n}") for n in (4, 5, 6) if len(word) >= n))


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


@dataclass
class Machine:
    """score(x) = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>) over the terms i of a text."""

    index: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def active(self, text: str | None, known: dict[str, tuple[int, ...]]) -> list[int]:
        found: set[int] = set()
        if len(known) > _MOST:
            known.clear()
        for word in words_of(text):
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
            if at:
                found.update(at)
        return sorted(found)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        at, doc = _flat(rows)
        return _sigmoid(_raw(at, doc, len(rows), self.bias, self.w, self.v)[0])


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """All terms of ``rows`` (lists or arrays) in turn, and the row of each."""
    n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    if rows and isinstance(rows[0], np.ndarray):
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), n)
    return np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(n.sum())), np.repeat(np.arange(len(rows)), n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _raw(at, doc, n, bias, w, v):
    z = bias + np.bincount(doc, w[at], n)
    sums = np.stack([np.bincount(doc, v[at, f], n) for f in range(v.shape[1])], 1) if v.shape[1] else np.zeros((n, 0))
    squares = np.bincount(doc, (v[at] ** 2).sum(1), n)
    return z + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(rows: list, labels: np.ndarray, index: dict[int, int], rank: int = RANK, epochs: int = 30, batch: int = 1024, seed: int = 7) -> Machine:
    """Adam on the logistic loss, with a small L2 penalty on the weights that a batch touches."""
    rng = np.random.default_rng(seed)
    n, m = len(rows), len(index)
    share = (labels.sum() + 0.5) / (n + 2)  # without labels nothing is toxic
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, rank))
    if n == 0 or m == 0 or labels.min() == labels.max():
        return Machine(index, bias, w, v)
    moments = [np.zeros(1), np.zeros(1), np.zeros(m), np.zeros(m), np.zeros((m, rank)), np.zeros((m, rank))]
    step = 0
    batch = min(batch, max(32, n // 8))
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.03 * (1 - epoch / epochs) + 0.002
        for k in range(0, n, batch):
            some = order[k : k + batch]
            at, doc = _flat([rows[i] for i in some])
            z, sums = _raw(at, doc, len(some), bias, w, v)
            g = (_sigmoid(z) - labels[some]) / len(some)
            gw = np.bincount(at, g[doc], m) + 1e-5 * w
            gv = np.zeros((m, rank))
            np.add.at(gv, at, g[doc, None] * (sums[doc] - v[at]))
            gv += 1e-5 * v
            step += 1
            for j, (p, gr) in enumerate(((None, np.array([g.sum()])), (w, gw), (v, gv))):
                a, b = moments[2 * j], moments[2 * j + 1]
                a += 0.1 * (gr - a)
                b += 0.01 * (gr * gr - b)
                move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
                if p is None:
                    bias -= float(move[0])
                else:
                    p -= move
    return Machine(index, bias, w, v)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, rank: int = RANK) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows that are not held out.

    Term counts and the fitted rows' terms come from Spark; the driver holds ``features`` counts and, for
    each fitted row, the few of those terms that it has.
    """
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    picked = picked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")
    rows = common.stored(rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = {}
        flush = lambda: pa.RecordBatch.from_pydict({"t": pa.array(seen.keys(), pa.int64()), "n0": pa.array([x[0] for x in seen.values()], pa.int64()), "n1": pa.array([x[1] for x in seen.values()], pa.int64())})
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[int] = set()
                for w in words_of(text):
                    if w not in known:
                        known[w] = terms_of(w)
                    found.update(known[w])
                for t in found:
                    if t in seen:
                        seen[t][y > 0] += 1
                    else:
                        seen[t] = [int(y <= 0), int(y > 0)]
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
                if len(known) > _MOST // 2:
                    known.clear()
        if seen:
            yield flush()

    totals = rows.agg(F.count("y").alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("n1")).first()
    n, n1 = totals["n"], totals["n1"]
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n - n1 + 1))
    surety = F.abs(odds) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    counts = rows.mapInArrow(common.lean(count), "t long, n0 long, n1 long").groupBy("t").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST_DF).withColumn("z", surety).where("z > 2.5").orderBy(F.desc("z"), "t").limit(features)
    index = {r["t"]: i for i, r in enumerate(best.select("t").collect())}
    blank = Machine(index, 0.0, np.zeros(0), np.zeros((0, 0)))
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                some = b.slice(k, 1000)
                found = [np.array(shared.value.active(t, known), dtype="<i4").tobytes() for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], ["y", "at"])

    # the driver holds terms as bytes, four each
    table = rows.mapInArrow(common.lean(active), "y int, at binary").toArrow()
    got = sorted(zip(table.column("y").to_pylist(), table.column("at").to_pylist(), strict=True))  # the fit is the same however the rows were dealt
    del table
    common.dropped(rows)
    return fit([np.frombuffer(at, dtype="<i4") for _, at in got], np.array([float(y > 0) for y, _ in got]), index, rank)


def scored(docs: DataFrame, machine: Machine, text: str = "text", into: str = "_score") -> DataFrame:
    """``docs`` with a column ``into`` (which replaces one of that name); every other column stays."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    columns = [c for c in docs.columns if c != into]
    docs = docs.select(*[F.col(common.quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    names, at = docs.columns, columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                some = b.slice(k, 1000)
                rows = [shared.value.active(t, known) for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(shared.value.scores(rows), pa.float64())], [*names, "score"])

    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in docs.schema], T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(common.lean(score), out).toDF(*columns, into)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document: doc_id, held_out, score, predicted."""
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
