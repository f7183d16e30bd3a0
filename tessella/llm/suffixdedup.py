"""Removal of repeated byte strings with suffix arrays.

Every byte inside a ``LENGTH``-byte string that also starts in a document with a smaller doc_id goes.
Strings are judged on the input; matches do not cross documents.

1. Documents are cut where a hash of 8 bytes says so. A chunk, with the ``LENGTH - 1`` bytes behind it, holds
   all strings that start in it: if a smaller document has an equal chunk, they all go. What is left to sort are first chunks, which hold
   the first of every string.
2. A string's minimizer is the least hash among the ``K``-byte strings in it, so equal strings have equal
   minimizers. Each document's different minimizers are counted over the corpus into two bitmaps
   whose size grows with the text up to a limit: those that two documents have, and those that very many have. Other strings repeat nothing.
3. Consecutive strings that may repeat, with one minimizer of ``DEAL`` bytes, form a segment. Tasks send each
   different segment once, with its smallest doc_id, to the shard of that minimizer; where very many documents
   share, strings are sent one by one and dealt by their own hash, which splits the shard and merges what is equal.
4. A shard lays the segments of a group side by side at their minimizer, trims each to what it shares with any other, and merges
   what is equal then. It sorts the suffixes of those by external induction (see ``induced``), which also gives the common prefixes of
   neighbours: strings that share ``LENGTH`` bytes get the smallest doc_id among them. A segment left alone with its minimizer needs
   no sorting: its strings are nowhere else. So for each segment it is known what goes in its first document;
   in any later document the whole segment goes.
5. Documents learn this by the segment's hash, and drop the union of their ranges.

A shard has about ``SHARD`` bytes, or one group if that is larger; of a group over ``MEMORY`` symbols text, order and common prefixes are
files of the task. Groups are sorted in up to ``ROUNDS`` rounds, one after another, so that only one round's segments are on disk twice.
The bitmaps only thin out what is sorted: where they fill up, more is, and results are the same.

Edge cases: null and empty texts have no bytes; texts under ``LENGTH`` bytes keep all; rows that share
a doc_id are not smaller than each other, so neither loses what only the other has (they are told apart by a hash of their text); rows with a null
doc_id keep all and are no one's source; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, induced

LENGTH, K, DEAL = 50, 32, 16
#: Chunks have 2^CUT bytes on average.
CUT = 7
#: A minimizer in this many documents is split by the strings themselves.
MANY = 4096
#: Bytes that are sorted at once where groups are small, and symbols of a larger group that memory holds.
SHARD, MEMORY = 1_000_000, 1 << 22
#: Strings of a segment at most (only periodic text has more with one minimizer), and records that a task groups before it sends them.
RUN, HELD = 4096, 200_000
#: Segments of a group that are trimmed; a larger group is sorted as it is.
TRIMMED = 5000
#: Bytes of text for each part that chunks are dealt to.
PER_PART = 16 << 20
#: Bytes of text whose segments are sorted in one round, and rounds at most.
PER_ROUND, ROUNDS = 256 << 20, 8
#: Bytes of text for which the census has its least bits; for more it has up to 2^``MOST_BITS``.
SPARSE, MOST_BITS = 1 << 30, 30

_CHUNK = np.dtype([("h", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values."""
    span = 1
    while 2 * span <= w:
        h = np.minimum(h[: h.size - span], h[span:])
        span *= 2
    return np.minimum(h[: h.size - (w - span)], h[w - span :]) if w > span else h


def chunks(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Where the chunks of a text's strings begin: cuts depend on 8 bytes, and never lie inside a run of one byte."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    eight = np.ndarray(n, dtype="<u8", buffer=text, strides=(1,))
    with np.errstate(over="ignore"):
        h = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT)
    cut = np.flatnonzero((h[1:] == 0) & (eight[1:] != eight[:-1])) + 1
    return np.r_[0, cut]


class Windows:
    """The strings of ``length`` bytes in several texts, less those that start in ranges ``gone`` of each, and their minimizers."""

    def __init__(self, texts: list[bytes], gone: list[list[tuple[int, int]]] | None = None, length: int = LENGTH, k: int = K):
        self.data, self.length = b"".join(texts), length
        x = np.frombuffer(self.data, dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(size) - size
        counts = np.maximum(size - length + 1, 0)
        self.at = np.repeat(self.begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))  # where each string starts in data
        self.doc = np.repeat(np.arange(size.size), counts)
        if gone and any(gone):
            there = np.ones(x.size, dtype=bool)
            for b, ranges in zip(self.begin.tolist(), gone, strict=True):
                for at, n in ranges:
                    there[b + at : b + at + n] = False
            keep = there[self.at]
            self.at, self.doc = self.at[keep], self.doc[keep]
        self.least = np.zeros(0, dtype=np.uint64)
        if self.at.size:
            up, self.down = common.powers(x.size + 1)
            with np.errstate(over="ignore"):
                self.sums = np.r_[np.uint64(0), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: x.size], dtype=np.uint64)]
            self.least = self._minimizers(k)[self.at]

    def _minimizers(self, k: int, both: bool = False):
        with np.errstate(over="ignore"):
            h = common.mixed((self.sums[k:] - self.sums[:-k]) * self.down[: self.sums.size - k])
        least = _least(h, self.length - k + 1)
        return (least, h) if both else least

    def _hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mixed((self.sums[at + k] - self.sums[at]) * self.down[at])

    def _runs(self) -> np.ndarray:
        """The first string of every run with one minimizer in one text."""
        return np.flatnonzero(np.r_[True, (self.least[1:] != self.least[:-1]) | (self.doc[1:] != self.doc[:-1])])

    def different(self) -> np.ndarray:
        """Each text's different minimizers."""
        if not self.at.size:
            return self.least
        firsts = self._runs()
        h, d = self.least[firsts], self.doc[firsts]
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        return h[np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]]

    def segments(self, shared: common.BitFilter, many: common.BitFilter) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, start, end, group, place of the minimizer) of maximal runs of strings that may repeat; single strings where many documents share."""
        if not self.at.size:
            return
        firsts = self._runs()
        there = shared.has(self.least[firsts])
        if not there.any():
            return
        n = np.diff(np.r_[firsts, self.at.size])
        often = np.repeat(there & many.has(self.least[firsts]), n)
        one = np.flatnonzero(np.repeat(there, n))
        often, p, d = often[one], self.at[one], self.doc[one]
        least, h = self._minimizers(DEAL, True)
        group = least[p]
        group[often] = self._hashes(p[often], self.length)
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (group[1:] != group[:-1]) | often[1:] | often[:-1]])
        n = np.diff(np.r_[new, one.size])
        if n.max() > RUN:  # periodic text
            parts = -(-n // RUN)
            new = np.repeat(new, parts) + RUN * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        last = np.r_[new[1:], one.size] - 1
        start = self.begin[d[new]]
        place = np.zeros(new.size, dtype=np.int64)
        for j in range(self.length - DEAL, -1, -1):  # the first of equal ones
            place[h[p[new] + j] == group[new]] = j
        yield from zip(d[new].tolist(), (p[new] - start).tolist(), (p[last] - start + self.length).tolist(), group[new].view(np.int64).tolist(), place.tolist(), strict=True)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _later(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks sorted by (hash, doc): the records, and which of them a smaller document has."""
    records = records[np.lexsort((records["doc"], records["k"], records["h"]))]
    new = np.r_[True, (records["h"][1:] != records["h"][:-1]) | (records["k"][1:] != records["k"][:-1])]
    first = records["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return records, records["doc"] > first


_GONE = "doc long, tag long, at int, n int"
MET, SENT = 0, 1


def _gone(rows: DataFrame, size: int) -> DataFrame:
    """``_GONE``: the chunks that equal one of a smaller document. ``rows``: doc, tag, text."""
    parts = common.partitions(rows.sparkSession, size, PER_PART)
    most = HELD

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            records, later = _later(np.concatenate(held))
            if later.any():
                yield common.deal(MET, records[later], 1)
            yield common.deal(SENT, records[~later], parts)
            held.clear()

        for b in batches:
            for doc, tag, text in zip(*b.columns, strict=True):
                data = _data(text.as_py())
                begin = chunks(data)
                if not begin.size:
                    continue
                end = np.r_[begin[1:], len(data) - LENGTH + 1]
                keys = b"".join([xxhash.xxh3_128_digest(data[x : y + LENGTH - 1]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                out = np.empty(begin.size, dtype=_CHUNK)
                out["h"], out["k"] = np.frombuffer(keys, dtype="<u8").reshape(-1, 2).T
                out["doc"], out["tag"], out["at"], out["n"] = doc.as_py(), tag.as_py(), begin, end - begin
                held.append(out)
                size += begin.size
                if size > most:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def told(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(records[c]) for c in ("doc", "tag", "at", "n")], ["doc", "tag", "at", "n"])

    def judged(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        records, later = _later(records)
        yield from told(records[later])

    dealt = common.stored(rows.mapInArrow(common.lean(emit), common.DEALT), "repeats-chunks", ("kind",))
    met = common.gathered(dealt.where(F.col("kind") == MET), _CHUNK, told, _GONE, False)
    gone = common.stored(met.unionByName(common.gathered(dealt.where(F.col("kind") == SENT), _CHUNK, judged, _GONE)), "repeats-gone")
    common.dropped(dealt)
    return gone


def _read(batches: Iterator[pa.RecordBatch], size: int = 1 << 18) -> Iterator[tuple[list[int], list[int], list[bytes], list[list[tuple[int, int]]]]]:
    """(rows, docs, texts, gone) of a few documents at a time, without those that are gone whole."""
    rows, docs, texts, gone, n = [], [], [], [], 0
    for b in batches:
        for row, doc, text, at, k in zip(*b.columns, strict=True):
            data, doc = _data(text.as_py()), doc.as_py()
            ranges = list(zip(at.as_py() or (), k.as_py() or (), strict=True))
            if doc is None or sum(k for _, k in ranges) >= len(data) - LENGTH + 1:
                continue
            rows.append(row.as_py())
            docs.append(doc)
            texts.append(data)
            gone.append(ranges)
            n += len(data)
            if n > size:
                yield rows, docs, texts, gone
                rows, docs, texts, gone, n = [], [], [], [], 0
    if rows:
        yield rows, docs, texts, gone


def census_bits(size: int) -> int:
    """So that the filters of ``size`` bytes of text are as sparse as those of ``SPARSE``, as far as memory goes."""
    return min(MOST_BITS, common.Census.BITS + max(0, -(-size // SPARSE) - 1).bit_length())


def _census(rows: DataFrame, bits: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = common.Census(bits=bits)
        for _, _, texts, gone in _read(batches):
            yield from held.add(Windows(texts, gone).different())
        yield from held.flush()

    return rows.mapInArrow(common.lean(count), common.Census.SCHEMA)


SEGMENT, OCCURRENCE, REPEAT = range(3)


def _segments(rows: DataFrame, shared, many, rounds: int) -> DataFrame:
    """Different segments with the smallest doc_id of those that a task holds; the places where segments are in those documents;
    the places of others, which are repeats. The group says in which of ``rounds`` a segment is sorted."""
    names = ["kind", "round", "key", "group", "segment", "doc", "at", "row", "n"]  # ``at`` of a segment: where its minimizer is
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    most = HELD

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        new: dict[bytes, tuple[int, bytes, int]] = {}
        places: list[tuple[bytes, int, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if new:
                keys = list(new)
                group, segment, place = zip(*new.values(), strict=True)
                cols = [np.full(len(keys), SEGMENT), [g % rounds for g in group], keys, group, segment, [first[k] for k in keys], place]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), *(pa.nulls(len(keys), t) for t in kinds[7:])], names)
            if places:
                key, doc, at, row, n = zip(*places, strict=True)
                kind = [OCCURRENCE if first[k] == d else REPEAT for k, d in zip(key, doc, strict=True)]
                turn = [new[k][0] % rounds if x == OCCURRENCE else 0 for k, x in zip(key, kind, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip((kind, turn, key), kinds, strict=False)), pa.nulls(len(key), kinds[3]), pa.nulls(len(key), kinds[4]), *(pa.array(c, t) for c, t in zip((doc, at, row, n), kinds[5:], strict=True))], names)
            for x in (first, new, places):
                x.clear()

        for rows, docs, texts, gone in _read(batches):
            for d, a, b, group, place in Windows(texts, gone).segments(shared.value, many.value):
                s = texts[d][a:b]
                key, doc = xxhash.xxh3_128_digest(s), docs[d]
                if key not in first:
                    first[key] = doc
                    new[key] = (group, s, place)
                    size += b - a + 200
                elif doc < first[key]:
                    first[key] = doc
                places.append((key, doc, a, rows[d], b - a))
            if size > 24 << 20 or len(places) > most:
                yield from flush()
                size = 0
        yield from flush()

    return rows.mapInArrow(common.lean(emit), "kind int, round int, key binary, group long, segment binary, doc long, at int, row long, n int")


class Shard:
    """Segments to be sorted together: their bytes one after another, each with a separator, in memory or (``most`` exceeded) in a file."""

    def __init__(self, folder: Path, most: int):
        self.path, self.most = folder / "segments", most
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, segment: bytes, doc: int) -> None:
        self.docs.append(doc)
        self.sizes.append(len(segment))
        self.held.append(segment)
        self.size += len(segment) + 1
        if self.size - self.written > self.most:
            with self.path.open("ab") as f:
                self._symbols().tofile(f)
            self.held.clear()
            self.written = self.size

    def _symbols(self) -> np.ndarray:
        out = np.frombuffer(b"\0".join([*self.held, b""]), dtype=np.uint8).astype(np.uint16)
        out += 1
        ends = np.cumsum([len(s) + 1 for s in self.held]) - 1
        out[ends] = 0  # between segments: below every byte
        return out

    def symbols(self) -> np.ndarray:
        if not self.written:
            return self._symbols()
        if self.held:
            with self.path.open("ab") as f:
                self._symbols().tofile(f)
        return np.memmap(self.path, dtype=np.uint16, mode="r")


def repeats(shard: Shard, folder: Path, length: int = LENGTH, memory: int = MEMORY) -> list[list[tuple[int, int]]]:
    """For each segment of ``shard`` the strings that also start in a smaller document than its own: (first start, last end) of runs of them."""
    text = shard.symbols()
    end = np.cumsum(np.array(shard.sizes, dtype=np.int64) + 1) - 1
    docs = np.array(shard.docs, dtype=np.int64)
    order, pre = induced.suffix_array(text, memory, folder)
    space = induced.Space(folder, memory)
    go = space.array(text.size, bool)
    a = 0
    while a < order.size:
        b, step = min(order.size, a + space.step), space.step
        while b < order.size:  # where a neighbour has less in common no group goes on
            cuts = np.flatnonzero(np.asarray(pre[a + 1 : b + 1]) < length)
            if cuts.size:
                b = a + 1 + int(cuts[-1])
                break
            step *= 2
            b = min(order.size, b + step)
        item, same = np.array(order[a:b]), np.array(pre[a:b])
        group = np.cumsum(same < length)
        owner = np.searchsorted(end, item)
        fits = end[owner] - item >= length
        item, group, doc = item[fits], group[fits], docs[owner[fits]]
        if item.size:
            firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            least = np.repeat(np.minimum.reduceat(doc, firsts), np.diff(np.r_[firsts, item.size]))
            go[item[least < doc]] = True
        a = b
    out: list[list[tuple[int, int]]] = [[] for _ in shard.sizes]
    begin = end - np.array(shard.sizes)
    for a, b in space.cuts(go.size):
        at = np.flatnonzero(go[a:b]) + a
        if at.size:
            owner = np.searchsorted(end, at)
            cut = np.r_[True, (at[1:] > at[:-1] + 1) | (owner[1:] != owner[:-1])]
            x, y, of = at[cut], at[np.r_[cut[1:], True]] + length, owner[cut]
            for s, i, j in zip(of.tolist(), (x - begin[of]).tolist(), (y - begin[of]).tolist(), strict=True):
                out[s].append((i, j))
    return out


def distinct(text: bytes, length: int = LENGTH) -> tuple[list[tuple[int, int]], list[int]]:
    """The ranges of ``text`` in which its strings start that come first of equal ones, and for each string where that is.

    Periodic text, whose suffixes would take a step of induction each, has few.
    """
    first: dict[bytes, int] = {}
    same = [first.setdefault(text[i : i + length], i) for i in range(len(text) - length + 1)]
    parts: list[tuple[int, int]] = []
    for i, j in enumerate(same):
        if i == j:
            if parts and parts[-1][1] == i + length - 1:
                parts[-1] = (parts[-1][0], i + length)
            else:
                parts.append((i, i + length))
    return parts, same


def spread(found: list[tuple[int, int]], same: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """``found``, runs of strings that come first of equal ones, with all equal ones."""
    go = {i for a, b in found for i in range(a, b - length + 1)}
    out: list[tuple[int, int]] = []
    for i, j in enumerate(same):
        if j in go:
            if out and out[-1][1] == i + length - 1:
                out[-1] = (out[-1][0], i + length)
            else:
                out.append((i, i + length))
    return out


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _alike(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _reach(parts: list[bytes]) -> list[int]:
    """For each the longest common prefix with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out, last = [0] * len(parts), 0
    for i, j in zip(order, order[1:], strict=False):
        n = _alike(parts[i], parts[j])
        out[i], last = max(last, n), n
    out[order[-1]] = last
    return out


def trimmed(segments: list[tuple[bytes, int]], length: int = LENGTH, k: int = DEAL) -> list[tuple[int, int]]:
    """The range of each segment (text, place of the minimizer) outside which it has no string of ``length`` in common with another.

    All strings of a segment contain the minimizer, so two that are equal lie alike around it: if each segment has it once.
    """
    s, p = segments[0]
    word = s[p : p + k]
    if any(t[q : q + k] != word or t.find(word, q + 1) >= 0 for t, q in segments):
        return [(0, len(t)) for t, _ in segments]
    right = _reach([t[q + k :] for t, q in segments])
    left = _reach([t[:q][::-1] for t, q in segments])
    return [(q - x, q + k + y) if x + k + y >= length else (0, 0) for (_, q), x, y in zip(segments, left, right, strict=True)]


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _sorted_shards(segments: DataFrame, parts: int) -> DataFrame:
    """(key, first, ranges) of every different segment: its smallest doc_id and what goes there."""
    most, memory, few = SHARD, MEMORY, TRIMMED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[bytes, int, list]] = []  # segments that need no sorting
        # others: (key, doc, parts, same); a part is (start, end, text of the shard, or none and whether it goes)
        users: list[tuple[bytes, int, list[tuple[int, int, int | None, bool]], list[int] | None]] = []

        def told(rows: list[tuple[bytes, int, list]]) -> pa.RecordBatch:
            keys, docs, found = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in r] for r in found], _RANGES)], ["key", "first", "ranges"])

        def rows() -> Iterator[tuple[int, bytes, bytes, int, int]]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def close(group: list[list], whole: bool) -> None:
            """Deals with the different segments [key, text, doc, place] of a group, or some of a large one."""
            if len(group) < 2 and not whole:
                known.extend((k, d, []) for k, _, d, _ in group)
                return
            several = [t.find(t[q : q + DEAL], q + 1) >= 0 for _, t, _, q in group]
            ranges = [(0, len(t)) for _, t, _, _ in group] if whole or any(several) else trimmed([(t, q) for _, t, _, q in group])
            parts = [distinct(t) if s else ([r] if r[1] > r[0] else [], None) for (_, t, _, _), r, s in zip(group, ranges, several, strict=True)]
            texts: dict[bytes, int] = {}
            for (_, t, d, _), (some, _) in zip(group, parts, strict=True):
                for a, b in some:
                    texts[t[a:b]] = min(d, texts.get(t[a:b], d))
            at = {}
            if whole or len(texts) > 1:
                for t, d in texts.items():
                    at[t] = len(shard.docs)
                    shard.add(t, d)
            for (k, t, d, _), (some, same) in zip(group, parts, strict=True):
                users.append((k, d, [(a, b, at.get(t[a:b]) if d == texts[t[a:b]] else None, d > texts[t[a:b]]) for a, b in some], same))

        def done() -> Iterator[pa.RecordBatch]:
            if users:
                found = repeats(shard, folder, memory=memory) if shard.size else []
                rows = []
                for k, d, some, same in users:
                    go = [x for a, b, i, all_of in some for x in ([(x + a, y + a) for x, y in found[i]] if i is not None else [(a, b)] if all_of else [])]
                    rows.append((k, d, go if same is None else spread(go, same)))
                yield told(rows)
                users.clear()
            if known:
                yield told(known)
                known.clear()

        with tempfile.TemporaryDirectory(prefix="repeats-") as top:
            number = 0

            def fresh() -> tuple[Path, Shard]:
                nonlocal number
                number += 1
                folder = Path(top) / str(number)
                folder.mkdir()
                return folder, Shard(folder, memory)

            folder, shard = fresh()
            group, held, large = None, [], False
            for k, g, s, d, q in rows():
                if g != group:
                    close(held, large)
                    group, held, large = g, [], False
                    if shard.size > most or len(users) > 50_000:
                        yield from done()
                        folder, shard = fresh()
                    elif len(known) > 20_000:
                        yield told(known)
                        known.clear()
                if held and k == held[-1][0]:
                    held[-1][2] = min(d, held[-1][2])
                    continue
                if len(held) >= few:
                    close(held, True)
                    held, large = [], True
                held.append([k, s, d, q])
            close(held, large)
            yield from done()

    rows = segments.select("key", "group", "segment", "doc", "at").repartition(parts, "group").sortWithinPartitions("group", "key")
    return rows.mapInArrow(common.lean(run), "key binary, first long, ranges array<struct<a: long, b: long>>")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(row, doc, text, at, n) of every row: a number of its own, and the starts and sizes of its chunks that are gone; the bytes of all texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    gone = _gone(rows.where("doc is not null and text is not null").select("doc", "tag", "text"), size)
    by_row = gone.groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n")).alias("g")).select("doc", "tag", F.col("g.at").alias("at"), F.col("g.n").alias("n"))
    out = common.stored(rows.join(by_row, ["doc", "tag"], "left").select(F.monotonically_increasing_id().alias("row"), "doc", "text", "at", "n"), "repeats-rows")
    common.dropped(gone)
    return out, size


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, data (the bytes that stay), n_bytes, n_removed and n_spans of every row."""
    spark = docs.sparkSession
    rows, size = _numbered(docs, text)
    bits, rounds = census_bits(size), min(ROUNDS, max(1, -(-size // PER_ROUND)))
    shared, many = common.Census.filters(_census(rows, bits), (2, MANY), bits)
    shared, many = spark.sparkContext.broadcast(shared), spark.sparkContext.broadcast(many)
    sent = common.stored(_segments(rows, shared, many, rounds), "repeats-segments", ("kind", "round"))
    shared.unpersist()
    many.unpersist()
    own = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
    whole = F.array(F.struct(F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n")).cast("long").alias("b")))
    found = sent.where(F.col("kind") == REPEAT).select("row", whole.alias("r"))
    # groups are sorted and told in rounds, so that the disk holds one round's shuffle at a time
    for i in range(rounds):
        segments, places = (sent.where((F.col("kind") == kind) & (F.col("round") == i)) for kind in (SEGMENT, OCCURRENCE))
        known = common.stored(_sorted_shards(segments, -(-common.partitions(spark) // rounds)), "repeats-known")
        common.dropped(sent, f"kind={SEGMENT}/round={i}")
        told = places.select("key", "doc", "row", F.col("at").cast("long").alias("at"), "n").join(known, "key")
        told = told.select("row", F.when(F.col("doc") > F.col("first"), whole).otherwise(own).alias("r")).where(F.size("r") > 0)
        found = found.unionByName(common.stored(told, "repeats-found"))
        common.dropped(sent, f"kind={OCCURRENCE}/round={i}")
        common.dropped(known)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("r")).alias("ranges"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0

            def done() -> pa.RecordBatch:
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "data", "n_bytes", "n_removed", "n_spans"])

            for doc, t, at, n, go in zip(*b.columns, strict=True):
                data = _data(t.as_py())
                spans = merged([*((a, a + k + LENGTH - 1) for a, k in zip(at.as_py() or (), n.as_py() or (), strict=True)), *((r["a"], r["b"]) for r in go.as_py() or ())])
                rest, end = [], 0
                for x, y in spans:
                    rest.append(data[end:x])
                    end = y
                rest.append(data[end:])
                left = b"".join(rest)
                out.append((doc.as_py(), left, len(data), len(data) - len(left), len(spans)))
                size += len(left)
                if size > 4 << 20:
                    yield done()
                    out, size = [], 0
            yield done()

    both = rows.join(found, "row", "left").select(F.col("doc").alias("doc_id"), "text", "at", "n", "ranges")
    return both.mapInArrow(common.lean(drop), "doc_id long, data binary, n_bytes long, n_removed long, n_spans long")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once strings of 50 bytes that smaller doc_ids have are gone."""
    out = kept(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


def brute(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The definition with a dictionary of all strings, for tests."""
    texts = {d: (t or "").encode("utf-8", "surrogatepass") for d, t in docs}
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - length + 1):
            first.setdefault(texts[d][i : i + length], d)
    out = {}
    for d, t in texts.items():
        spans = merged([(i, i + length) for i in range(len(t) - length + 1) if first[t[i : i + length]] < d])
        go = {i for a, b in spans for i in range(a, b)}
        left = bytes(c for i, c in enumerate(t) if i not in go)
        out[d] = (len(t), len(go), len(spans), hashlib.sha256(left).hexdigest())
    return out
