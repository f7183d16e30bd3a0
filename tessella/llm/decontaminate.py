"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. The automaton of all
items is small (at most two states a word) and goes to every executor; documents stream through it,
and the longest match that ends at each word is tracked. A window is ``length`` consecutive words of
an item, or a shorter item as a whole.

Edge cases: a null or empty text has no words and is clean; a null or empty item has no window; items
with equal texts all count; an item without an item_id hits words but is not among the items found; repeated document rows each get
their own result; an empty table gives an
empty result; other columns of the input are passed by or kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of items in one automaton; more items than that are taken in blocks, one pass each.
MOST_WORDS = 500_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of several word sequences; a state is a set of substrings that end at the same places."""

    def __init__(self, items: list[tuple[int, list[bytes]]], length: int):
        self.length = length
        self.code: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for _, item in items:
            last = 0
            for w in item:
                last = self._extend(last, self.code.setdefault(w, len(self.code)))
        self.items: list[set[int] | None] = [None] * len(self.size)  # of the window of full length in a state
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.size]  # (words, item) of short items in a state
        for item_id, item in items:
            if 0 < len(item) < length:
                self.whole[self._state(item)].append((len(item), item_id))
            for at in range(len(item) - length + 1):
                v = self._state(item[at : at + length])
                if self.items[v] is None:
                    self.items[v] = set()
                self.items[v].add(item_id)
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.full = [-1] * len(self.size)  # the state on the suffix path that holds the window of full length
        for v in order:
            up = self.link[v]
            self.full[v] = v if self.size[up] < length <= self.size[v] else self.full[up]
            if up > 0 and self.whole[up]:
                self.whole[v] = self.whole[v] + self.whole[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, q, c)
        cur = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, item: list[bytes]) -> int:
        v = 0
        for w in item:
            v = self.next[v][self.code[w]]
        return v

    def hits(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) ranges of words inside any window, and the items whose windows occur."""
        nxt, link, size, full, whole, length = self.next, self.link, self.size, self.full, self.whole, self.length
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = run = 0
        for i, c in enumerate(map(self.code.get, doc)):
            if c is None:
                v = run = 0
                continue
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                run = size[v]
                to = nxt[v].get(c)
            if to is None:
                continue
            v, run = to, run + 1
            if run >= length and (u := full[v]) >= 0:
                found |= self.items[u] or set()
                spans.append((i + 1 - length, i + 1))
            if whole[v]:
                for n, item in whole[v]:
                    if n <= run:
                        found.add(item)
                        spans.append((i + 1 - n, i + 1))
        if len(spans) > 1:
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    if b > merged[-1][1]:
                        merged[-1] = (merged[-1][0], b)
                else:
                    merged.append((a, b))
            spans = merged
        found.discard(None)
        return spans, found


_machines: dict[str, SuffixAutomaton] = {}
common.CACHES["automata"] = _machines.clear


def _machine(name: str, items: list[tuple[int, list[bytes]]], length: int) -> SuffixAutomaton:
    """The worker's own automaton of a block of items: made once, however many tasks it runs; the last two are kept."""
    if name not in _machines:
        while len(_machines) > 1:
            del _machines[next(iter(_machines))]
        _machines[name] = SuffixAutomaton(items, length)
    return _machines[name]


def _blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' words in lists of at most ``most`` words (or one item)."""
    block, n = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        w = words(r["t"])
        if not w:
            continue
        if block and n + len(w) > most:
            yield block
            block, n = [], 0
        block.append((r["i"], w))
        n += len(w)
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """For every row of ``docs``: ``keep``, n_words, spans (merged word ranges that are hit) and items (ids, sorted as numbers).

    Documents are not shuffled. While the items fit one automaton they are read once; else the rows are
    written with a row number, each block of items passes over them, and the blocks' hits are joined.
    """
    spark = docs.sparkSession
    blocks = list(_blocks(items, "item_id", "text", most_words)) or [[]]
    schema = "n_words long, spans array<struct<a: long, b: long>>, items array<long>"

    def over(df: DataFrame, kept: tuple[str, ...], block: list, only_hits: bool) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _machine(name, shared.value, length)
            for b in batches:
                n, spans, found = [], [], []
                for t in b.column(len(kept)).to_pylist():
                    w = words(t or "")
                    s, f = machine.hits(w)
                    n.append(len(w))
                    spans.append([{"a": a, "b": b} for a, b in s])
                    found.append(sorted(f))
                out = pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(found, pa.list_(pa.int64()))], [*kept, "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hits else out

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
        return df.select(*kept, F.col(text).alias("_text")).mapInArrow(common.lean(scan, "automata"), f"{kinds}, {schema}" if kept else schema)

    if len(blocks) == 1:
        return over(docs, keep, blocks[0], False)
    rows = common.stored(docs.select(*keep, F.col(text).alias("_words_of")).withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    hit = None
    for block in blocks:
        one = over(rows.withColumnRenamed("_words_of", text), ("_row",), block, True)
        hit = one if hit is None else hit.unionByName(one)
    counted = over(rows.withColumnRenamed("_words_of", text), (*keep, "_row"), [], False).drop("spans", "items")
    merged = hit.groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x)))
    merged = merged.select("_row", F.aggregate("s", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)"), step).alias("spans"), "items")
    none = F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)"), F.expr("cast(array() as array<bigint>)")
    return counted.join(merged, "_row", "left").select(*keep, "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` (ranges of word numbers) and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, items: DataFrame, length: int = 10, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the hit words; a document with a larger share of hit words than ``max_coverage`` goes altogether.

    Rows without a hit come back unchanged, in all their columns.
    """
    columns, kinds = docs.columns, docs.schema
    text = f"c{columns.index(text)}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = tuple(docs.columns)
    out = contamination(docs, items, length, names, text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            for i, (s, n) in enumerate(zip(b.column(len(names) + 1).to_pylist(), b.column(len(names)).to_pylist(), strict=True)):
                hit = sum(x["b"] - x["a"] for x in s)
                keep.append(hit <= max_coverage * n)
                if hit and keep[-1]:
                    texts[i] = cut(texts[i], [(x["a"], x["b"]) for x in s])
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, list(names)).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(common.lean(clean, "automata"), docs.schema).toDF(*columns).select(*[F.col(common.quoted(f.name)).alias(f.name, metadata=f.metadata) for f in kinds])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, the words inside 10-word windows of benchmark items, and the items whose windows occur."""
    docs, items = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = contamination(docs, items)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], length: int = 10) -> dict:
    """The definition of op9 word by word, for tests on small tables."""
    sets = [(i, words(t or "")) for i, t in items]
    out = {}
    for doc, t in docs:
        w = words(t or "")
        hit, found = set(), set()
        for i, item in sets:
            n = min(length, len(item))
            wins = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(i)
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out
