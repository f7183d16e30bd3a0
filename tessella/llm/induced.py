"""Suffix sorting by external induction: suffixes with their common prefixes pass through queues on disk.

The order of all suffixes follows from that of the S*-suffixes (those smaller than the next but after
one that is larger): a sweep upwards takes suffixes by first symbol and sends the larger suffix before each to a
queue, a sweep downwards does so for the smaller ones. S*-suffixes are ordered by the same sweeps over their
substrings, named, and sorted by recursion where names repeat.

What the queue carries is (symbol, suffix, common prefix with the one sent before it to that symbol). Symbols count
with their type (L or S), so suffixes in different buckets have nothing in common, and the common prefix of two that follow each
other in a bucket is one more than the least between the two that sent them: a minimum over what the sweep took
meanwhile, kept as a stack of minima of blocks. In the sweep over substrings two seeds of a symbol are alike without end, so
equal substrings are those whose common prefix is endless: names need no comparison of symbols. Common prefixes in names
become common prefixes in symbols by the minimum over the names between.

The queue is monotone: what a sweep sends never sorts before what it has taken. So it is kept as ranges of
symbols; ranges ahead grow in arrays that go to files when they exceed the memory limit, and only the range being
taken is sorted in memory. Text, types, orders and common prefixes of more than that many items are files as well,
read and written in pieces. Files are a task's own and go with it.
"""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np

ENDLESS = 1 << 40

Triple = tuple[np.ndarray, np.ndarray, np.ndarray]


class Space:
    """Arrays in memory up to ``memory`` items, as files in ``folder`` beyond."""

    def __init__(self, folder: Path, memory: int):
        self.folder, self.memory = folder, memory
        self.step = max(1 << 12, memory // 4)

    def array(self, n: int, dtype=np.int64, fill: int = 0) -> np.ndarray:
        if n <= self.memory:
            return np.full(n, fill, dtype=dtype)
        out = np.memmap(self.folder / uuid.uuid4().hex, dtype=dtype, mode="w+", shape=(n,))
        if fill:
            for a, b in self.cuts(n):
                out[a:b] = fill
        return out

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.step):
            yield a, min(n, a + self.step)


class Queue:
    """Triples (symbol, suffix, common prefix) by symbol, first in first out within one. ``bounds``: the first symbol of each range but the first."""

    def __init__(self, bounds: np.ndarray, space: Space):
        self.bounds, self.folder, self.memory = bounds, space.folder, space.memory
        self.name = uuid.uuid4().hex
        self.ahead: list[list[np.ndarray]] = [[] for _ in range(bounds.size + 1)]
        self.files: set[int] = set()
        self.held = 0

    def send(self, symbols: np.ndarray, items: np.ndarray, common: np.ndarray) -> None:
        at = np.searchsorted(self.bounds, symbols, side="right")
        order = np.argsort(at, kind="stable")
        at, every = at[order], np.stack([symbols[order], items[order], common[order]], 1)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), at.size], strict=True):
            self.ahead[at[a]].append(every[a:b])
        self.held += items.size
        if self.held > self.memory:
            for i, parts in enumerate(self.ahead):
                if parts:
                    with (self.folder / f"{self.name}-{i}").open("ab") as f:
                        for p in parts:
                            f.write(p.tobytes())
                    self.files.add(i)
                    self.ahead[i] = []
            self.held = 0

    def take(self, i: int) -> Triple:
        parts = self.ahead[i]
        self.ahead[i] = []
        self.held -= sum(len(p) for p in parts)
        if i in self.files:
            path = self.folder / f"{self.name}-{i}"
            parts = [np.fromfile(path, dtype=np.int64).reshape(-1, 3), *parts]
            path.unlink()
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        every = np.concatenate(parts)
        order = np.argsort(every[:, 0], kind="stable")
        return every[order, 0], every[order, 1], every[order, 2]


class Roughly:
    """Seeds known by their first symbol only: alike without end within one."""

    def __init__(self, queue: Queue):
        self.queue = queue

    def take(self, i: int) -> Triple:
        symbols, items, common = self.queue.take(i)
        if symbols.size:
            common = np.where(np.r_[True, symbols[1:] != symbols[:-1]], 0, ENDLESS)
        return symbols, items, common


class Sorted:
    """Seeds in order, or (``down``) to be taken from the last: suffixes and the common prefix of each with the one before."""

    def __init__(self, text: np.ndarray, order: np.ndarray, common: np.ndarray, bounds: np.ndarray, down: bool):
        self.text, self.order, self.common, self.down = text, order, common, down
        n = order.size
        at = (lambda j: -int(text[order[n - 1 - j]])) if down else (lambda j: int(text[order[j]]))
        self.cuts = [0, *(bisect_left(range(n), int(b), key=at) for b in bounds), n]

    def take(self, i: int) -> Triple:
        a, b, n = self.cuts[i], self.cuts[i + 1], self.order.size
        if not self.down:
            items = np.array(self.order[a:b])
            return self.text[items].astype(np.int64), items, np.array(self.common[a:b])
        items = np.array(self.order[n - b : n - a][::-1])
        common = np.array(self.common[n - b + 1 : n - a + 1][::-1])
        return -self.text[items].astype(np.int64), items, common if common.size == items.size else np.r_[0, common]


class Minima:
    """The least common prefix between two places of a sweep that are blocks apart."""

    def __init__(self, space: Space, symbols: int):
        self.last, self.tail = space.array(symbols, fill=-1), space.array(symbols)
        self.block, self.at, self.least = 0, [], []

    def sent(self, common: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefixes of what is sent to ``symbols`` from ``places`` of a block, with what was sent there before."""
        order = np.argsort(symbols, kind="stable")
        c, p = symbols[order], places[order]
        first = np.r_[True, c[1:] != c[:-1]]
        out = np.empty(c.size, dtype=np.int64)
        head = np.flatnonzero(first)
        seen = c[head]
        before = self.last[seen]
        between = np.searchsorted(self.at, before, side="right")
        least = np.minimum(np.minimum.accumulate(common)[p[head]], self.tail[seen])
        out[head] = np.where(before < 0, -1, np.minimum(least, np.array([*self.least, ENDLESS])[between]))
        inner = np.flatnonzero(~first)
        if inner.size:
            a, b = p[inner - 1] + 1, p[inner]
            k = np.frexp(b - a + 1)[1] - 1
            table, found = common, np.empty(inner.size, dtype=np.int64)
            for j in range(int(k.max()) + 1):
                if j:
                    half = 1 << j - 1
                    table = np.minimum(table[:-half], table[half:])
                now = np.flatnonzero(k == j)
                if now.size:
                    found[now] = np.minimum(table[a[now]], table[b[now] - (1 << j) + 1])
            out[inner] = found
        end = p[np.r_[head[1:] - 1, c.size - 1]]
        after = np.r_[np.minimum.accumulate(common[::-1])[::-1], ENDLESS]
        self.tail[seen], self.last[seen] = after[end + 1], self.block
        back = np.empty_like(out)
        back[order] = out + 1
        return back

    def passed(self, least: int) -> None:
        while self.least and self.least[-1] >= least:
            self.least.pop()
            self.at.pop()
        self.least.append(least)
        self.at.append(self.block)
        self.block += 1


def _sweep(text: np.ndarray, is_s: np.ndarray, seeds: Roughly | Sorted, down: bool, space: Space, bounds: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The L-suffixes in rising order (or, ``down``, the S-suffixes in falling order) that ``seeds``, sorted likewise, induce:
    in blocks, each with its common prefix with the one before.

    Within a symbol what was induced comes before the seeds. Symbols are negated for a sweep down.
    """
    sign = -1 if down else 1
    queue, minima = Queue(bounds, space), Minima(space, symbols)
    for r in range(bounds.size + 1):
        sym, item, pre = queue.take(r)
        s_sym, s_item, s_pre = seeds.take(r)
        top = bounds[r] if r < bounds.size else np.iinfo(np.int64).max
        look = 4096
        while item.size or s_item.size:
            # the next ones in order: induced before seeds of the same symbol
            a, b = min(look, sym.size), min(look, s_sym.size)
            if a == look:
                b = min(b, int(np.searchsorted(s_sym[:b], sym[a - 1], side="left")))
            if b == look:
                a = min(a, int(np.searchsorted(sym[:a], s_sym[b - 1], side="right")))
            n = a + b
            if b and a:
                from_seed = np.zeros(n, dtype=bool)
                at = np.searchsorted(sym[:a], s_sym[:b], side="right") + np.arange(b)
                from_seed[at] = True
                other = np.flatnonzero(~from_seed)
                symbols_, every, common = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
                for out, x, y in ((symbols_, s_sym, sym), (every, s_item, item), (common, s_pre, pre)):
                    out[at], out[other] = x[:b], y[:a]
            else:
                from_seed = np.full(n, b > 0)
                symbols_, every, common = (s_sym[:b], s_item[:b], s_pre[:b]) if b else (sym[:a], item[:a], pre[:a])
            before = every - 1
            sends = (before >= 0) & (is_s[before] == down)
            to = np.where(sends, sign * text[before], np.iinfo(np.int64).max)
            least = np.minimum.accumulate(np.r_[np.iinfo(np.int64).max, to[:-1]])
            stop = np.flatnonzero(np.where(from_seed, symbols_ >= least, symbols_ > least))
            took = int(stop[0]) if stop.size else n
            look = min(1 << 15, 2 * look) if took == n else max(256, min(look, 2 * took))
            new = ~from_seed[:took]
            k = int(np.count_nonzero(new))
            if k:
                yield every[:took][new], common[:took][new]
            sym, item, pre, s_sym, s_item, s_pre = sym[k:], item[k:], pre[k:], s_sym[took - k :], s_item[took - k :], s_pre[took - k :]
            common = common[:took]
            places = np.flatnonzero(sends[:took])
            if places.size:
                t_sym, t_item = to[places], before[places]
                t_pre = minima.sent(common, places, sign * t_sym)
                here = t_sym < top
                ahead = ~here
                if here.any():
                    h_sym, h_item, h_pre = t_sym[here], t_item[here], t_pre[here]
                    order = np.argsort(h_sym, kind="stable")
                    h_sym = h_sym[order]
                    spot = np.searchsorted(sym, h_sym, side="right")
                    sym, item, pre = np.insert(sym, spot, h_sym), np.insert(item, spot, h_item[order]), np.insert(pre, spot, h_pre[order])
                if ahead.any():
                    queue.send(t_sym[ahead], t_item[ahead], t_pre[ahead])
            minima.passed(int(common.min()))


def _types(text: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next (the last is), and for how many symbols each first symbol repeats."""
    n = text.size
    is_s, run = space.array(n, bool), space.array(n)
    is_s[n - 1], run[n - 1] = True, 1
    for a, b in reversed(list(space.cuts(n - 1))):
        step = np.sign(text[a + 1 : b + 1].astype(np.int64) - text[a:b])
        size = b - a
        place = np.where(step != 0, np.arange(size), size)
        following = np.minimum.accumulate(place[::-1])[::-1]  # where the next change is
        inside = following < size
        is_s[a:b] = np.where(inside, step[np.minimum(following, size - 1)] > 0, is_s[b])
        run[a:b] = np.where(inside, following - np.arange(size) + 1, size - np.arange(size) + run[b])
    return is_s, run


def _collected(blocks: Iterator[tuple[np.ndarray, np.ndarray]], n: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    order, common, at = space.array(n), space.array(n), 0
    for items, pre in blocks:
        order[at : at + items.size], common[at : at + items.size] = items, pre
        at += items.size
    return order, common


def _stars_only(blocks: Iterator[tuple[np.ndarray, np.ndarray]], is_s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a sweep the S*-suffixes; what is between two of them tells their common prefix."""
    held = ENDLESS
    for items, pre in blocks:
        there = np.flatnonzero(is_s[items] & ~is_s[np.maximum(items - 1, 0)] & (items > 0))
        if there.size:
            least = np.minimum.reduceat(pre[: there[-1] + 1], np.r_[0, there[:-1] + 1])
            least[0] = min(int(least[0]), held)
            yield items[there], least
            held = int(pre[there[-1] + 1 :].min()) if there[-1] + 1 < pre.size else ENDLESS
        else:
            held = min(held, int(pre.min()))


def _rising(order: np.ndarray, common: np.ndarray, first: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """``first`` and then what a sweep down gave, turned round."""
    n = order.size
    out, pre = space.array(n + 1), space.array(n + 1)
    out[0] = first
    for a, b in space.cuts(n):
        out[n - b + 1 : n - a + 1] = order[a:b][::-1]
        pre[n - b + 2 : n - a + 2] = common[a:b][::-1][: n + 1 - (n - b + 2)]
    if n:
        pre[1] = 0
    return out, pre


class _Least:
    """The least of ``values`` over ranges, by a table of powers of two."""

    def __init__(self, values: np.ndarray, space: Space):
        self.tables = [values]
        while (1 << len(self.tables)) <= values.size:
            half, last = 1 << len(self.tables) - 1, self.tables[-1]
            table = space.array(last.size - half)
            for a, b in space.cuts(table.size):
                table[a:b] = np.minimum(last[a:b], last[a + half : b + half])
            self.tables.append(table)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b], not empty."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(a.size, dtype=np.int64)
        for j in np.unique(k).tolist():
            now = np.flatnonzero(k == j)
            out[now] = np.minimum(self.tables[j][a[now]], self.tables[j][b[now] - (1 << j) + 1])
        return out


def _sorted_stars(text: np.ndarray, is_s: np.ndarray, sweeps, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """The S*-suffixes in order, with their common prefixes."""
    n = text.size - 1
    count = sum(int(np.count_nonzero(is_s[a + 1 : b + 1] & ~is_s[a:b])) for a, b in space.cuts(n))
    stars, at = space.array(count), 0
    for a, b in space.cuts(n):
        some = np.flatnonzero(is_s[a + 1 : b + 1] & ~is_s[a:b]) + a + 1
        stars[at : at + some.size] = some
        at += some.size
    rough, pre = _rising(*_collected(_stars_only(sweeps(None, None, stars), is_s), count - 1, space), n, space)
    names, least, number = space.array(count), space.array(count + 1), 0  # ``least``: of a name and the one before
    for a, b in space.cuts(count):
        new = pre[a:b] < ENDLESS
        name = number + np.cumsum(new) - (a == 0)
        names[np.searchsorted(stars, rough[a:b])] = name
        least[name[new]] = pre[a:b][new]
        number = int(name[-1])
    if number + 1 == count:
        return rough, pre
    order, same = _level(names, space)
    ranges = _Least(least[: number + 1], space)
    for a, b in space.cuts(count):
        y = np.asarray(order[a:b])
        rough[a:b] = stars[y]
        x = np.r_[order[a - 1] if a else y[0], y[:-1]]
        k = np.array(same[a:b])
        if a == 0:
            x, y, k = x[1:], y[1:], k[1:]
            pre[0] = 0
        if y.size:
            pre[max(a, 1) : b] = stars[x + k] - stars[x] + ranges.of(names[x + k] + 1, names[y + k])
    return rough, pre


def _level(symbols: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    n = symbols.size
    if n < 2:
        return np.arange(n), np.zeros(n, dtype=np.int64)
    text = space.array(n + 1)  # with a last symbol below all others
    most = 0
    for a, b in space.cuts(n):
        text[a:b] = symbols[a:b]
        text[a:b] += 1
        most = max(most, int(text[a:b].max()))
    count = space.array(most + 1)
    for a, b in space.cuts(n + 1):
        part = np.bincount(text[a:b])
        count[: part.size] += part
    is_s, run = _types(text, space)
    used = np.flatnonzero(count)
    total = np.cumsum(count[used])
    width = max(1 << 12, min(1 << 16, space.memory // 4))
    first = np.flatnonzero(np.diff(total // width, prepend=0))
    ranges = used[np.unique(np.r_[first, np.minimum(first + 1, used.size - 1)])] if first.size else used[:0]
    up, down = np.sort(ranges), np.sort(1 - ranges)
    n_s = sum(int(np.count_nonzero(is_s[a:b])) for a, b in space.cuts(n + 1))

    def low_from(seeds: Roughly | Sorted) -> tuple[np.ndarray, np.ndarray]:
        return _collected(_sweep(text, is_s, seeds, False, space, up, most + 1), n + 1 - n_s, space)

    def high_from(low: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # the S*-suffixes are induced anew, so only L-suffixes seed the sweep down
        return _sweep(text, is_s, Sorted(text, *low, down, True), True, space, down, most + 1)

    def rough_sweeps(_a, _b, stars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        queue = Queue(up, space)
        for a, b in space.cuts(stars.size):
            some = np.array(stars[a:b])
            queue.send(text[some].astype(np.int64), some, np.zeros_like(some))
        return high_from(low_from(Roughly(queue)))

    stars = _sorted_stars(text, is_s, rough_sweeps, space)
    low = low_from(Sorted(text, *stars, up, False))
    high = _rising(*_collected(high_from(low), n_s - 1, space), n, space)
    order, common, at = space.array(n + 1), space.array(n + 1), 0
    lows, highs = Sorted(text, *low, up, False), Sorted(text, *high, up, False)
    last = n
    for r in range(up.size + 1):  # within a symbol L before S
        (a_sym, a_item, a_pre), (b_sym, b_item, b_pre) = lows.take(r), highs.take(r)
        spot = np.searchsorted(a_sym, b_sym, side="right") + np.arange(b_sym.size)
        size = a_sym.size + b_sym.size
        if not size:
            continue
        there = np.zeros(size, dtype=bool)
        there[spot] = True
        items, pre = np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
        items[spot], items[~there], pre[spot], pre[~there] = b_item, a_item, b_pre, a_pre
        # equal symbols of different types: both runs go on together until the shorter ends
        before = np.r_[last, items[:-1]]
        p, q = before + pre, items + pre
        pre += np.where((text[p] == text[q]) & (p != q), np.minimum(run[p], run[q]), 0)
        order[at : at + size], common[at : at + size] = items, pre
        at, last = at + size, items[-1]
    return order[1:], common[1:]


def suffix_array(text: np.ndarray, memory: int = 1 << 22, folder: Path | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes of ``text`` in order, and each one's common prefix with the one before; symbols are non-negative.

    ``memory``: items that a queue or an array holds; what is larger lies in ``folder`` (a temporary one that goes at the end,
    so that results of that size are copied) and passes in pieces.
    """
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="induced-") as d:
            order, common = _level(text, Space(Path(d), memory))
            return np.array(order), np.array(common)
    return _level(text, Space(folder, memory))
