"""External induced sorting: suffixes of a sequence in order, each with the length it shares with its neighbour.

Left-most S-type (LMS) substrings are sorted by induction and named; the sequence of names, if they repeat, is sorted by
recursion. From the sorted LMS suffixes one scan upwards induces the L-type suffixes and one scan downwards the
S-type ones. Queues keyed by symbol hold the tuples (place, common prefix) still to be scanned: within a symbol tuples arrive in
suffix order, so the queue that serves the least symbol first is a priority queue. Queues spill to
files once they pass a memory budget and are read back block by block; sequence, types and all arrays over LMS suffixes are memory-mapped files once
they pass it, filled and read in blocks. A scan takes a block of waiting tuples of a symbol at once; a tuple's common prefix is one more than the minimum over
the tuples scanned since the last one that went to the same symbol. The recursion ends with a sequence that memory holds (``base`` names).
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np

from .repeats import Disk

_FAR = np.int32(2**31 - 1)
#: Names of a reduced sequence that are sorted in memory, without another recursion.
BASE_NAMES = 1 << 22
_BLOCK = 1 << 20


class Queues:
    """First-in-first-out queues of (place, common prefix) by symbol, spilled to disk past ``budget`` tuples."""

    def __init__(self, disk: Disk, budget: int):
        self.disk, self.budget = disk, max(1, budget)
        self.parts: dict[int, list] = {}
        self.sizes: dict[int, int] = {}
        self.held = 0

    def push(self, symbol: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((place, lcp))
        self.sizes[symbol] = self.sizes.get(symbol, 0) + place.size
        self.held += place.size
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Move the larger queues to files until half the budget is free."""
        for symbol in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.held <= self.budget // 2 or not self.sizes[symbol]:
                return
            whole = [x for x in self.parts[symbol] if not isinstance(x, str)]
            path = f"{self.disk.path()}.npy"
            np.save(path, np.stack([np.concatenate([x[0] for x in whole]), np.concatenate([x[1] for x in whole]).astype(np.int64)]))
            kept = [x for x in self.parts[symbol] if isinstance(x, str)]
            self.parts[symbol] = [*kept, path]  # whatever is in memory came after what is on disk
            self.held -= self.sizes[symbol]
            self.sizes[symbol] = 0

    def pop(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The first (or last) tuples of the symbol in order: one file, or all that are in memory; none when the queue is empty."""
        parts = self.parts.get(symbol)
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        if isinstance(parts[-1 if last else 0], str):
            path = parts.pop(-1 if last else 0)
            place, lcp = np.load(path)
            os.unlink(path)
            return place, lcp.astype(np.int32)
        held = [x for x in parts if not isinstance(x, str)]
        self.parts[symbol] = [x for x in parts if isinstance(x, str)]
        self.held -= self.sizes.pop(symbol, 0)
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])

    def symbols(self) -> list[int]:
        return list(self.parts)


class InducedSorter:
    """Sorts the suffixes of ``text`` (whole numbers from 1 up)."""

    def __init__(self, text: np.ndarray, disk: Disk, base: int = BASE_NAMES):
        self.disk, self.base = disk, base
        n = self.n = text.size + 1  # with a sentinel 0 at the end
        self.t = disk.array(n, text.dtype)
        for a, b in self._blocks(text.size):
            self.t[a:b] = text[a:b]
        self.s = disk.array(n, np.bool_)
        self._types()

    def _blocks(self, size: int, start: int = 0) -> Iterator[tuple[int, int]]:
        step = min(_BLOCK, max(1, self.disk.budget))
        for a in range(start, size, step):
            yield a, min(a + step, size)

    def _types(self) -> None:
        """A suffix is of type S if it is smaller than the next one; runs of one symbol take the type of their end."""
        step, n = 1 << 22, self.n
        self.s[-1] = True
        after = True  # type of the suffix after the block
        for b in range(n - 1, 0, -step):
            a = max(0, b - step)
            x, y = self.t[a:b], self.t[a + 1 : b + 1]
            known = np.where(x < y, 1, np.where(x > y, 0, -1)).astype(np.int8)
            at = np.where(known[::-1] >= 0, np.arange(b - a), -1)
            at = np.maximum.accumulate(at)
            out = np.where(at >= 0, known[::-1][np.maximum(at, 0)] == 1, after)
            self.s[a:b] = out[::-1]
            after = bool(self.s[a])

    def _lms(self) -> np.ndarray:
        found = self.disk.spool(np.int64)
        for a, b in self._blocks(self.n, 1):
            found.add(np.flatnonzero(self.s[a:b] & ~self.s[a - 1 : b - 1]) + a)
        return found.array()

    def _by_symbol(self, places: np.ndarray) -> np.ndarray:
        """``places`` in the order of their symbols, stable: dealt out block by block."""
        counts = self.disk.array(int(max(int(self.t[a:b].max()) for a, b in self._blocks(self.n))) + 2, np.int64)
        for a, b in self._blocks(places.size):
            np.add.at(counts, self.t[places[a:b]].astype(np.int64) + 1, 1)
        np.cumsum(counts, out=counts)
        out = self.disk.array(places.size, np.int64)
        for a, b in self._blocks(places.size):
            own = places[a:b]
            symbols = self.t[own].astype(np.int64)
            order = np.argsort(symbols, kind="stable")
            symbols = symbols[order]
            first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            within = np.arange(symbols.size) - np.repeat(first, np.diff(np.append(first, symbols.size)))
            out[counts[symbols] + within] = own[order]
            np.add.at(counts, symbols, 1)
        return out

    def _run(self, place: int) -> int:
        c, i = self.t[place], place
        while i < self.n and self.t[i] == c:
            i += 1
        return i - place

    @staticmethod
    def _deal(queues: Queues, symbols: np.ndarray, places: np.ndarray, index: np.ndarray, lcp: np.ndarray, since: dict[int, int] | None) -> None:
        """Send the tuples induced by a scanned stretch (common prefixes ``lcp``; sources at ``index``) to their queues.

        Without ``since`` only the order counts, as for LMS substrings, and common prefixes stay 0.
        """
        if since is None:
            order = np.argsort(symbols, kind="stable")
            symbols, places = symbols[order], places[order]
            cuts = [0, *(np.flatnonzero(symbols[1:] != symbols[:-1]) + 1).tolist(), symbols.size]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    queues.push(int(symbols[a]), places[a:b], np.zeros(b - a, np.int32))
            return
        seen = np.append(lcp, _FAR)
        lowest = int(lcp.min()) if lcp.size else int(_FAR)
        if symbols.size:
            order = np.argsort(symbols, kind="stable")
            symbols, places, index = symbols[order], places[order], index[order]
            first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
            low = np.zeros(symbols.size, np.int64)
            low[1:] = index[:-1] + 1
            low[first] = 0
            bounds = np.empty(2 * symbols.size, np.int64)
            bounds[::2], bounds[1::2] = low, index + 1
            value = np.minimum.reduceat(seen, bounds)[::2].astype(np.int64)
            kinds = symbols[first].tolist()
            value[first] = np.minimum(value[first], np.array([since.get(c, 0) for c in kinds]))
            value = np.minimum(value + 1, int(_FAR)).astype(np.int32)
            value[first[[c not in since for c in kinds]]] = 0  # nothing of this symbol before
            ends = np.append(first[1:], symbols.size)
            touched = {}
            for c, a, b in zip(kinds, first.tolist(), ends.tolist(), strict=True):
                queues.push(c, places[a:b], value[a:b])
                last = int(index[b - 1]) + 1
                touched[c] = int(seen[last:].min())
        else:
            touched = {}
        for c in since:
            if since[c] > lowest:
                since[c] = lowest
        since.update(touched)

    def _bounds(self, lms: np.ndarray) -> dict[int, tuple[int, int]]:
        """Where the LMS places of each symbol stand in their order."""
        out: dict[int, tuple[int, int]] = {}
        for a, b in self._blocks(lms.size):
            symbols = self.t[lms[a:b]]
            cuts = np.concatenate([[0], np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [b - a]]).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                c = int(symbols[x])
                out[c] = (out[c][0] if c in out else a + x, a + y)
        return out

    def induce(self, lms: np.ndarray, lcp: np.ndarray, carry: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From sorted LMS places, all places in falling order, each with the prefix it shares with the one before (if ``carry``)."""
        lms_of = self._bounds(lms)
        budget = self.disk.budget // 8
        left, done = Queues(self.disk, budget), Queues(self.disk, budget)
        since: dict[int, int] | None = {} if carry else None
        waiting = _Heap(lms_of)
        while (c := waiting.pop()) is not None:
            last = None
            while True:  # tuples of this symbol may bring more of it
                place, common = left.pop(c)
                if not place.size:
                    break
                if last is None:
                    common[:1] = 0
                last = int(place[-1])
                done.push(c, place, common)
                self._scan_left(place, common, left, since, waiting)
            if c in lms_of:
                for a, b in self._blocks(lms_of[c][1], lms_of[c][0]):
                    place, common = np.array(lms[a:b]), np.array(lcp[a:b])
                    if a == lms_of[c][0]:
                        common[0] = 0 if last is None else min(self._run(last), self._run(int(place[0])))
                    self._scan_left(place, common, left, since, waiting)
        right, since = Queues(self.disk, budget), {} if carry else None
        waiting = _Heap([-c for c in done.symbols()])
        while (c := waiting.pop()) is not None:
            c, last = -c, None
            while True:
                place, common = right.pop(c)
                if not place.size:
                    break
                if last is None:
                    common[:1] = 0
                last = int(place[-1])
                yield place, common
                self._scan_right(place, common, right, since, waiting)
            above = None  # what the last block's first tuple shares with the tuple before it
            while True:
                place, common = done.pop(c, last=True)
                if not place.size:
                    break
                place, common = place[::-1].copy(), np.append(common, 0)[::-1].copy()  # each with the one above it now
                head, common = int(common[-1]), common[:-1]
                common[0] = above if above is not None else 0 if last is None else min(self._run(last), self._run(int(place[0])))
                above = head
                yield place, common
                self._scan_right(place, common, right, since, waiting)
        yield np.array([self.n - 1]), np.zeros(1, np.int32)

    def _scan_left(self, place, common, queues, since, waiting) -> None:
        at = np.flatnonzero(place > 0)
        at = at[~self.s[place[at] - 1]]
        symbols = self.t[place[at] - 1]
        self._deal(queues, symbols, place[at] - 1, at, common, since)
        waiting.add(symbols, 1)

    def _scan_right(self, place, common, queues, since, waiting) -> None:
        at = np.flatnonzero(place > 0)
        at = at[self.s[place[at] - 1]]
        symbols = self.t[place[at] - 1]
        self._deal(queues, symbols, place[at] - 1, at, common, since)
        waiting.add(symbols, -1)

    def _shared(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and b share, up to ``limit``."""
        out = np.zeros(a.size, np.int64)
        live = np.flatnonzero(limit > 0)
        while live.size:
            i, j = a[live] + out[live], b[live] + out[live]
            inside = np.minimum(self.n - 1 - np.maximum(i, j), limit[live] - out[live])
            ok = inside > 0
            same = np.zeros(live.size, bool)
            same[ok] = self.t[i[ok]] == self.t[j[ok]]
            out[live[same]] += 1
            live = live[same]
        return out

    def ordered(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all suffixes in falling order with the prefix shared with the one before, exact up to ``most``."""
        lms = self._lms()
        if lms.size <= 1:
            yield from self.induce(lms, np.zeros(lms.size, np.int32))
            return
        # LMS substrings in order: induction from the LMS places ordered by their first symbol
        mark, end = self.disk.array(self.n, np.bool_), self.disk.array(self.n, np.int64)
        for a, b in self._blocks(lms.size):
            mark[lms[a:b]] = True
            end[lms[a:b]] = np.append(lms[a + 1 : b + 1], self.n - 1)[: b - a]
        in_order, at = self.disk.array(lms.size, np.int64), lms.size
        for place, _ in self.induce(self._by_symbol(lms), self.disk.array(lms.size, np.int32), carry=False):
            place = place[mark[place]]
            in_order[at - place.size : at] = place[::-1]
            at -= place.size
        name_of, last = self.disk.array(self.n, np.int64), 1
        for a, b in self._blocks(lms.size):
            own = np.array(in_order[max(a - 1, 0) : b])
            size = end[own] - own + 1
            pair = np.minimum(size[1:], size[:-1])
            shared = self._shared(own[:-1], own[1:], np.where(size[1:] == size[:-1], pair, 0))
            new = ((size[1:] != size[:-1]) | (shared < pair)).astype(np.int64)
            names = last + np.cumsum(new)
            if not a:
                names = np.concatenate([[1], names])
            name_of[in_order[a:b]] = names
            last = int(names[-1])
        name_at = self.disk.array(lms.size, np.int64)
        for a, b in self._blocks(lms.size):
            name_at[a:b] = name_of[lms[a:b]]
        rank = self.disk.array(lms.size, np.int64)
        if last == lms.size:
            for a, b in self._blocks(lms.size):
                rank[name_at[a:b] - 1] = np.arange(a, b)
        elif lms.size <= self.base:
            rank[:] = _by_doubling(np.asarray(name_at), most)
        else:
            at = lms.size
            for part, _ in InducedSorter(name_at, self.disk, self.base).ordered(most):
                part = part[part < lms.size]  # without the sentinel
                rank[at - part.size : at] = part[::-1]
                at -= part.size
        place, lcp = self.disk.array(lms.size, np.int64), self.disk.array(lms.size, np.int32)
        for a, b in self._blocks(lms.size):
            place[a:b] = lms[rank[a:b]]
            own = np.array(rank[max(a - 1, 0) : b])
            lcp[b - own.size + 1 : b] = self._common(lms, name_at, own[:-1], own[1:], most)
        yield from self.induce(place, lcp)

    def _common(self, lms: np.ndarray, names: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Symbols that the LMS suffixes numbered a and b share, up to ``most``: whole equal names, then the first unequal pair symbol by symbol."""
        a, b = a.copy(), b.copy()
        out = np.zeros(a.size, np.int64)
        live = np.arange(a.size)
        start = lambda x: np.where(x < names.size, lms[np.minimum(x, names.size - 1)], self.n)
        while live.size:
            i, j = a[live], b[live]
            going = (i < names.size) & (j < names.size) & (out[live] < most)
            live = live[going]
            i, j = i[going], j[going]
            same = names[i] == names[j]
            live, i = live[same], i[same]
            out[live] += start(i + 1) - start(i)
            a[live] += 1
            b[live] += 1
        rest = np.maximum(most - out, 0)
        rest[(a >= names.size) | (b >= names.size)] = 0
        return np.minimum(out + self._shared(start(a), start(b), rest), int(_FAR) - 1)


class _Heap:
    """The least of a growing set of symbols not yet served."""

    def __init__(self, symbols):
        self.heap = list(symbols)
        heapq.heapify(self.heap)
        self.known = set(self.heap)

    def add(self, symbols: np.ndarray, sign: int) -> None:
        for c in (np.flatnonzero(np.bincount(symbols)) if symbols.dtype == np.uint8 else np.unique(symbols)).tolist():
            if sign * c not in self.known:
                self.known.add(sign * c)
                heapq.heappush(self.heap, sign * c)

    def pop(self) -> int | None:
        return heapq.heappop(self.heap) if self.heap else None


def _by_doubling(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a sequence of LMS names in memory, by their first ``most`` symbols or more; ties beyond that stay in an arbitrary but fixed order.

    A rank is the first slot of a suffix's group; only slots of groups that are still tied are sorted again, by the rank of what follows.
    """
    n = names.size
    order = np.argsort(names, kind="stable")
    live = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)
    key = names[order]
    width = 0
    while True:
        new = np.ones(live.size, bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[live]] = live[np.maximum.accumulate(np.where(new, np.arange(live.size), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = live[tied]
        width = 2 * width or 1
        if not live.size or width * 2 > most + 1:  # a name stands for two symbols at least
            return order
        own = order[live]
        key = rank[own] * (n + 1) + rank[np.minimum(own + width, n)] + 1
        by = np.argsort(key, kind="stable")
        order[live], key = own[by], key[by]


def repeats(text: np.ndarray, width: int, disk: Disk, base: int = BASE_NAMES) -> Iterator[Iterator[np.ndarray]]:
    """Groups of places of ``text`` (symbols from 1 up) whose suffixes share ``width`` symbols or more, each as parts; some groups of one place too.

    Files lie in the folder of ``disk``; a task that is lost sorts its shard anew.
    """
    stretches = _stretches(InducedSorter(text, disk, base).ordered(width), width)
    held = next(stretches, None)
    while held is not None:
        following: list = []

        def group(first=held[1], following=following):
            yield first
            for new, part in stretches:
                if new:
                    following.append((new, part))
                    return
                yield part

        parts = group()
        yield parts
        for _ in parts:
            pass
        held = following[0] if following else None


def _stretches(ordered: Iterator[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[bool, np.ndarray]]:
    """Blocks of places cut where the common prefix is short: whether a cut comes before, and the places."""
    for place, common in ordered:
        bounds = np.concatenate([[0], np.flatnonzero(common < width), [place.size]])
        size = np.diff(bounds)
        known = size > 1  # of the others only the outer ones may go on in another block
        known[[0, -1]] = size[[0, -1]] > 0
        for x in np.flatnonzero(known).tolist():
            yield x > 0, place[bounds[x] : bounds[x + 1]]
