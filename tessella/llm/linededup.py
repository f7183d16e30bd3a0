"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

A line is the words between two newlines, split at white space; an edit inserts, deletes or replaces a
word. Lines come in the order of (doc_id, row, line number). A line with words goes if an
equal one comes before it; one of at least ``NEAR`` words also goes if a line of at least ``NEAR - 1`` words within ``EDITS`` (0 or 1)
edits comes before it, whether or not that one stays: of fewer words one is too large a part. Lines without words always stay.

1. Every document sends each of its different lines once, as a 128-bit hash with its place. Tasks group
   what they hold before they send it, so a line that all documents have goes out once for some hundred thousand lines.
2. Two lines one edit apart agree in their first or last half of words. Only lines that share such a half with a different one can have a
   neighbour, and only the deletions in the other half can show it: the rest emit nothing. Halves
   are dealt by their hash as bare numbers, so no table of a fixed size limits how many there are.
3. Those lines emit all their variants with one word deleted, and themselves, as hashed keys. Equal keys
   with the same deleted place are a replacement, a key equal to a whole line is an insertion; so the
   earliest line of (key, place) and of key tells every line its earliest neighbour, without a pair for each two lines of a group.
4. The edit distance of a line and its earliest neighbour is verified on their words, and the
   documents drop their lines.

Hashes of words, halves and variants come from prefix sums over a text, so a line of n words costs O(n).

Edge cases: null texts stay null; empty texts stay empty; null doc_ids come after all others; rows that share
a doc_id, or have none, are told apart by a hash of their text and come in its order; of those equal in text too all but one lose
their lines with words; an empty table gives no row; other
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NEAR, EDITS = 4, 1
#: Characters of text that are hashed at once, records that a task groups before it sends them, lines that it remembers.
PIECE, HELD, KNOWN = 1 << 18, 300_000, 200_000
#: Bytes of text for each part that records are dealt to.
PER_PART = 16 << 20
_LAST = (1 << 63) - 1

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: White space of several bytes in UTF-8, as one number each.
_WIDE = np.array(sorted(int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

KEYS, HALVES, MET, AGAIN, VARIANTS, PAIRS, TEXTS = range(7)
_KEY = np.dtype([("h", "<u8"), ("k", "<u8"), ("row", "<i8"), ("line", "<i4")])
_VARIANT = np.dtype([("h", "<u8"), ("at", "<i4"), ("row", "<i8"), ("line", "<i4")])


class Lines:
    """The lines of several texts in turn, each as a range of word hashes."""

    def __init__(self, texts: list[str]):
        data = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass")
        x = np.frombuffer(data, dtype=np.uint8)
        blank = _BLANK[x]
        lead = np.flatnonzero(_LEAD[x])
        if lead.size:
            one, two, three = (x[np.minimum(lead + j, x.size - 1)].astype(np.int64) for j in range(3))
            short = one == 0xC2
            wide = np.isin(one << 16 | two << 8 | np.where(short, 0, three), _WIDE)
            at, short = lead[wide], short[wide]
            blank[at] = blank[at + 1] = True
            blank[at[~short] + 2] = True
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if x.size and not blank[0]:
            edges = np.r_[0, edges]
        begin, end = edges[::2], edges[1::2]
        ends = np.flatnonzero(x == 10)
        self.first, self.last = np.searchsorted(begin, np.r_[0, ends[:-1] + 1]), np.searchsorted(begin, ends)
        self.size = self.last - self.first
        self.words = common.span_hashes(x, begin, end)
        up, self.down = common.powers(self.words.size + 2)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(self.words * up[: self.words.size], dtype=np.uint64)]

    def hashes(self, a: np.ndarray, b: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
        """Of the words from ``a`` to ``b``, less the one at ``without``, and of how many they are."""
        with np.errstate(over="ignore"):
            if without is None:
                return common.mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))
            left, right = (self.sums[without] - self.sums[a]) * self.down[a], (self.sums[b] - self.sums[without + 1]) * self.down[a + 1]
            return common.mixed(left + right + (b - a - 1).astype(np.uint64))

    def keys(self) -> list[bytes]:
        data = self.words.tobytes()
        return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(self.first.tolist(), self.last.tolist(), strict=True)]

    def halves(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of the first and last halves of the lines ``of``; a hash's lowest bit tells which."""
        lines, found = [], []
        a, b, n = self.first[of], self.last[of], self.size[of]
        for h in ((n - 1) // 2, n // 2):
            some = slice(None) if not found else n % 2 == 0
            for side, x, y in ((0, a, a + h), (1, b - h, b)):
                lines.append(of[some])
                found.append(self.hashes(x[some], y[some]) & ~np.uint64(1) | np.uint64(side))
        return np.concatenate(lines), np.concatenate(found)

    def variants(self, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash) of all lines whole (place -1) and with a word deleted behind a shared head or before a shared tail."""
        h = self.first + np.maximum(self.size - 1, 0) // 2
        begin, end = np.where(tail, self.first, h), np.where(head, self.last, h)
        n = np.where(self.size >= NEAR, np.maximum(end - begin, 0), 0)
        line = np.repeat(np.arange(n.size), n)
        at = np.arange(line.size) + np.repeat(begin - (np.cumsum(n) - n), n)
        cut = self.hashes(self.first[line], self.last[line], at)
        whole = np.arange(n.size)
        return np.r_[whole, line], np.r_[np.full(n.size, -1), at - self.first[line]], np.r_[self.hashes(self.first, self.last), cut]


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is inserted, deleted or replaced between ``a`` and ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _pieces(batches: Iterator[pa.RecordBatch], size_of: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """(rows, numbers of first lines, texts) of about ``size_of`` characters; a longer text comes in several, cut at newlines."""
    rows, firsts, texts, size = [], [], [], 0
    for b in batches:
        for row, text in zip(b.column(0), b.column(1), strict=True):
            row, text = row.as_py(), text.as_py()
            first = at = 0
            while at <= len(text):
                to = text.find("\n", at + size_of) if len(text) - at > 2 * size_of else -1
                part = text[at:to] if to >= 0 else text[at:]
                rows.append(row)
                firsts.append(first)
                texts.append(part)
                size += len(part)
                if size > size_of:
                    yield rows, firsts, texts
                    rows, firsts, texts, size = [], [], [], 0
                if to < 0:
                    break
                first += part.count("\n") + 1
                at = to + 1
    if rows:
        yield rows, firsts, texts


def _grouped(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (hash, key, place) and each one's group of equal (hash, key): records, group."""
    second = "k" if "k" in records.dtype.names else "at"
    records = records[np.lexsort((records["line"], records["row"], records[second], records["h"]))]
    new = (records["h"][1:] != records["h"][:-1]) | (records[second][1:] != records[second][:-1])
    return records, np.r_[0, np.cumsum(new)]


def _shared(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves that different lines have: those records, and two of each hash, or all of a hash that one line has alone."""
    records = records[np.lexsort((records["k"], records["h"]))]
    new = np.r_[True, records["h"][1:] != records["h"][:-1]]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], records.size] - 1
    there = records["k"][begin] != records["k"][end]
    hit = records[np.repeat(there, end - begin + 1)]
    keep = np.repeat(~there, end - begin + 1)
    keep[begin] = keep[end] = True
    return hit, records[keep]


def _census(docs: DataFrame, parts: int, near: bool) -> DataFrame:
    """Blobs of ``KEYS`` and ``HALVES``; of ``MET``, halves that the task itself saw twice, and ``AGAIN``, lines that it saw earlier."""
    piece, most, remembered = PIECE, HELD, KNOWN

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        keys, halves, again, size = [], [], [], 0
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                yield common.deal(KEYS, np.concatenate(keys), parts)
            if halves:
                hit, rest = _shared(np.concatenate(halves))
                if hit.size:
                    yield common.deal(MET, hit, 1)
                yield common.deal(HALVES, rest, parts)
            if again:
                yield common.deal(AGAIN, np.concatenate(again), 1)

        for rows, firsts, texts in _pieces(batches, piece):
            lines = Lines(texts)
            counts = [t.count("\n") + 1 for t in texts]
            row, n = np.repeat(rows, counts), np.concatenate([np.arange(f, f + c) for f, c in zip(firsts, counts, strict=True)])
            fresh, old = [], []
            for i, (r, key, words) in enumerate(zip(row.tolist(), lines.keys(), lines.size.tolist(), strict=True)):
                if not words:
                    continue
                if r != last:
                    last = r
                    if len(known) > remembered:
                        known.clear()
                if known.get(key, _LAST) <= r and key in known:
                    old.append(i)
                else:
                    known[key] = r
                    fresh.append((i, key))
            if old:
                out = np.zeros(len(old), dtype=_KEY)
                out["row"], out["line"] = row[old], n[old]
                again.append(out)
            if fresh:
                of = np.array([i for i, _ in fresh])
                out = np.zeros(of.size, dtype=_KEY)
                out["h"], out["k"] = np.frombuffer(b"".join(k for _, k in fresh), dtype="<u8").reshape(-1, 2).T
                out["row"], out["line"] = row[of], n[of]
                keys.append(out)
                long = lines.size[of] >= NEAR - 1
                if near and long.any():
                    place = np.zeros(lines.size.size, dtype=np.int64)
                    place[of] = np.arange(of.size)
                    line, h = lines.halves(of[long])
                    half = out[place[line]]
                    half["h"] = h
                    halves.append(half)
                    size += half.size
                size += out.size
            if size > most:
                yield from flush()
                keys, halves, again, size = [], [], [], 0
        yield from flush()

    return docs.mapInArrow(common.lean(emit), common.DEALT)


def _places(rows: DataFrame, dtype: np.dtype, f, keep: tuple[str, ...], whole: bool = True) -> DataFrame:
    """``f`` of every part's records (or, not ``whole``, of every blob where it lies), as rows of the fields ``keep``."""
    kinds = {"row": pa.int64(), "line": pa.int32(), "side": pa.int32(), "row2": pa.int64(), "line2": pa.int32()}

    def run(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = f(records)
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for k, c in zip(keep, found, strict=True)], list(keep))

    return common.gathered(rows, dtype, run, ", ".join(f"{k} {'long' if kinds[k] == pa.int64() else 'int'}" for k in keep), whole)


def _copies(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    records, group = _grouped(records)
    later = np.r_[False, group[1:] == group[:-1]]
    return records["row"][later], records["line"][later]


def _sides(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return hit["row"], hit["line"], (hit["h"] & np.uint64(1)).astype(np.int32)


def _neighbours(records: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line, row2, line2): variants with the earliest line that they show to be a neighbour, where it comes before."""
    records, group = _grouped(records)
    order = np.lexsort((records["line"], records["row"]))
    rank = np.empty(order.size, dtype=np.int64)
    rank[order] = np.arange(order.size)
    none = np.int64(order.size)
    alike = np.minimum.reduceat(rank, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))[group]
    begin = np.flatnonzero(np.r_[True, records["h"][1:] != records["h"][:-1]])
    same = np.repeat(np.arange(begin.size), np.diff(np.r_[begin, order.size]))
    whole = records["at"] < 0
    wholes = np.minimum.reduceat(np.where(whole, rank, none), begin)[same]
    cuts = np.minimum.reduceat(np.where(whole, none, rank), begin)[same]
    to = np.where(whole, cuts, np.minimum(alike, wholes))
    later = np.flatnonzero(to < none)
    here, there = records[later], records[order[to[later]]]
    ok = (there["row"] < here["row"]) | ((there["row"] == here["row"]) & (there["line"] < here["line"]))
    here, there = here[ok], there[ok]
    return here["row"], here["line"], there["row"], there["line"]


_CANDIDATES = f"{common.DEALT}, row long, line int, row2 long, line2 int, text string"


def _variants(able: DataFrame, parts: int) -> DataFrame:
    """Of (row, text, lines with their shared sides): variants as blobs, neighbours met in the same task, and the lines' texts."""
    names = [x.split()[0] for x in _CANDIDATES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()]

    piece, most = PIECE, HELD

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, places, texts, sides, held = [], [], [], [], []
        size = words = 0

        def hashed() -> None:
            nonlocal rows, places, texts, sides, size, words
            side = np.array(sides)
            line, at, h = Lines(texts).variants((side & 1) > 0, (side & 2) > 0)
            out = np.zeros(line.size, dtype=_VARIANT)
            out["h"], out["at"], out["row"], out["line"] = h, at, np.array(rows)[line], np.array(places)[line]
            held.append(out)
            words += out.size
            rows, places, texts, sides, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words
            records, group = _grouped(np.concatenate(held))
            first = np.r_[True, group[1:] != group[:-1]]
            to, later = records[first][group], ~first
            if later.any():
                a, b = records[later], to[later]
                yield batch(kind=np.full(a.size, PAIRS), row=a["row"], line=a["line"], row2=b["row"], line2=b["line"])
            sent = common.deal(VARIANTS, records[first], parts)
            yield batch(kind=sent.column(0), part=sent.column(1), data=sent.column(2))
            held.clear()
            words = 0

        for b in batches:
            for row, text, lines in zip(*b.columns, strict=True):
                row, text, found = row.as_py(), text.as_py().split("\n"), {}
                for x in lines.as_py():
                    found[x >> 1] = found.get(x >> 1, 0) | 1 << (x & 1)
                for i, side in found.items():
                    rows.append(row)
                    places.append(i)
                    texts.append(text[i])
                    sides.append(side)
                    size += len(text[i])
                    if size > piece or len(rows) > 5000:
                        yield batch(kind=np.full(len(rows), TEXTS), row=rows, line=places, text=texts)
                        hashed()
                        if words > most:
                            yield from flush()
        if rows:
            yield batch(kind=np.full(len(rows), TEXTS), row=rows, line=places, text=texts)
            hashed()
        if held:
            yield from flush()

    return able.mapInArrow(common.lean(emit), _CANDIDATES)


def _near(docs: DataFrame, census: DataFrame, parts: int) -> DataFrame:
    """(row, line) of the lines with an earlier line within one edit."""
    hit = _places(census.where(F.col("kind") == MET), _KEY, _sides, ("row", "line", "side"), False)
    met = _places(census.where(F.col("kind") == HALVES), _KEY, lambda r: _sides(_shared(r)[0]), ("row", "line", "side"))
    able = hit.unionByName(met).groupBy("row").agg(F.collect_set(F.col("line") * 2 + F.col("side")).alias("able"))
    found = common.stored(_variants(docs.join(able, "row").select("row", "text", "able"), parts), "line-variants", ("kind",))
    pairs = _places(found.where(F.col("kind") == VARIANTS), _VARIANT, _neighbours, ("row", "line", "row2", "line2"))
    pairs = pairs.unionByName(found.where(F.col("kind") == PAIRS).select("row", "line", "row2", "line2")).distinct()
    texts = found.where(F.col("kind") == TEXTS).select("row", "line", "text")
    other = texts.select(F.col("row").alias("row2"), F.col("line").alias("line2"), F.col("text").alias("text2"))
    pairs = pairs.join(texts, ["row", "line"]).join(other, ["row2", "line2"]).select("row", "line", "text", "text2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = x.split(), y.split()
                ok.append(min(len(x), len(y)) >= NEAR - 1 and max(len(x), len(y)) >= NEAR and within_one(x, y))
            yield pa.RecordBatch.from_arrays(list(b.columns[:2]), ["row", "line"]).filter(pa.array(ok, pa.bool_()))

    near = common.stored(pairs.mapInArrow(common.lean(verify), "row long, line int"), "line-near")
    common.dropped(found)
    return near


def _rows(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``docs`` (columns c0, c1, ...) with ``row``, which orders rows and tells all but equal ones apart, and ``copy``; and the bytes of text."""
    docs = docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    about = docs.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size")).agg(F.max("n").alias("most"), F.sum("size").alias("size")).first()
    if (about["most"] or 0) < 2:
        return docs.withColumn("row", F.col("doc")).withColumn("copy", F.lit(False)), about["size"] or 0
    docs = common.stored(docs.withColumns({"tag": F.xxhash64(text), "at": F.monotonically_increasing_id()}), "line-rows")
    each = docs.groupBy("doc", "tag").agg(F.min("at").alias("first")).withColumn("one", F.lit(1).cast("long"))
    each = common.with_starts(each, "doc", "one", "row", ("tag",)).select("doc", "tag", "first", "row")
    return docs.join(each, ["doc", "tag"]).withColumn("copy", F.col("at") != F.col("first")), about["size"] or 0


def deduplicated(docs: DataFrame, edits: int = EDITS, text: str = "text", n_lines: str = "_lines", n_removed: str = "_removed") -> DataFrame:
    """``docs`` with ``text`` less its duplicate lines, and columns ``n_lines`` and ``n_removed`` (which replace any of that name)."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]
    at = names.index(text)
    docs = docs.select(*[F.col(common.quoted(c)).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id"))
    docs, size = _rows(docs, f"c{at}")
    parts = common.partitions(docs.sparkSession, size, PER_PART)
    texts = docs.where(~F.col("copy")).select("row", F.col(f"c{at}").cast("string").alias("text")).where("text is not null")
    census = common.stored(_census(texts, parts, edits == 1), "lines", ("kind",))
    go = _places(census.where(F.col("kind") == KEYS), _KEY, _copies, ("row", "line"))
    go = go.unionByName(_places(census.where(F.col("kind") == AGAIN), _KEY, lambda r: (r["row"], r["line"]), ("row", "line"), False))
    go = common.stored(go, "line-copies")
    if edits:
        go = go.unionByName(_near(texts, census, parts))
    common.dropped(census)
    by_row = go.groupBy("row").agg(F.collect_set("line").alias("go"))
    rows = docs.join(by_row, "row", "left").select(*[f.name for f in fields], "go", "copy")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, removed = [], [], []
            for t, go, copy in zip(b.column(at), b.column(len(names)), b.column(len(names) + 1), strict=True):
                t, go = t.as_py(), go.as_py()
                n.append(0 if t is None else t.count("\n") + 1)
                removed.append(0)
                if t is not None and (go or copy.as_py()):
                    go = set(go or ())
                    keep = [x for k, x in enumerate(t.split("\n")) if not (x.split() if copy.as_py() else k in go)]
                    removed[-1] = n[-1] - len(keep)
                    t = "\n".join(keep)
                texts.append(t)
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*[f.name for f in fields], "n", "removed"])

    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("removed", T.LongType())])
    return rows.mapInArrow(common.lean(drop), out).toDF(*names, n_lines, n_removed)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one equals within one word: doc_id, n_lines, n_removed, kept_sha256, text."""
    out = deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


def brute(docs: list[tuple[int, str | None]], edits: int = EDITS) -> dict[int, str | None]:
    """The definition, line against line, for tests: kept text by doc_id (rows in ascending doc_id)."""
    earlier: list[list[str]] = []
    out = {}
    for doc, text in sorted(docs):
        keep = []
        for line in [] if text is None else text.split("\n"):
            w = line.split()
            gone = bool(w) and any(w == e or (edits and min(len(w), len(e)) >= NEAR - 1 and max(len(w), len(e)) >= NEAR and within_one(w, e)) for e in earlier)
            if w:
                earlier.append(w)
            if not gone:
                keep.append(line)
        out[doc] = None if text is None else "\n".join(keep)
    return out
