"""External induced suffix sorting.

Suffixes are of two types: S if smaller than the next one, else L. The S suffixes
that follow an L are the seeds. From sorted seeds one sweep upwards induces all L
suffixes and one downwards all S suffixes. A sweep reads suffix tuples (position,
common prefix with the one before) in sorted order from a priority queue and puts back
the tuples of the positions before them, keyed by their first symbol. Common-prefix
values are carried along: that of an induced tuple is one more than the least value
read since the last tuple of the same symbol; they are cut off at `cap`.

The order of the seeds comes from the same two sweeps over seeds in any order, which
sort the substrings from seed to seed; these are named, and the string of names is
sorted by recursion. Everything as long as the string is in files: text, types, seeds,
names, what the sweeps give and what the queues hold beyond `memory` tuples; pieces of
them are read in turn. A string of at most `in_memory` symbols ends the recursion: it
is sorted in memory, with some tens of bytes a symbol.
"""

from __future__ import annotations

import bisect
import heapq
import os
import tempfile
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 18


class Queue:
    """Tuples (symbol; position, common prefix) in memory, first in first out for each symbol."""

    def __init__(self):
        self.queues: dict[int, deque] = defaultdict(deque)

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            self.queues[symbol].append((pos, lcp))

    def pop(self, symbol: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a symbol, about `most` of them."""
        q = self.queues.get(symbol)
        if not q:
            return None
        got, n = [], 0
        while q and n < most:
            got.append(q.popleft())
            n += len(got[-1][0])
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got]), np.concatenate([v for _, v in got]))


def types_of(text: np.ndarray, out: np.ndarray) -> None:
    """out[i]: whether suffix i is smaller than suffix i + 1; the end of the text is the smallest symbol."""
    n, after = len(text), False
    for end in range(n, 0, -CHUNK):
        begin = max(0, end - CHUNK)
        here = np.asarray(text[begin:end]).astype(np.int64)
        nxt = np.append(here[1:], int(text[end]) if end < n else -1)
        sign = np.sign(nxt - here)
        # equal neighbours take the type of the next place that differs
        place = np.where(sign != 0, np.arange(len(sign)), len(sign))
        place = np.minimum.accumulate(place[::-1])[::-1]
        out[begin:end] = np.where(place < len(sign), sign[np.minimum(place, len(sign) - 1)] > 0, after)
        after = bool(out[begin])


def _packed(text: np.ndarray) -> np.ndarray | None:
    """Six symbols of the text in one number, from each place on; None where symbols need more than ten bits."""
    if not len(text) or int(text.max()) >= 1023:
        return None
    n = len(text)
    out = np.zeros(n, np.uint64)
    for k in range(6):
        out <<= np.uint64(10)
        out[: n - k] |= text[k:].astype(np.uint64) + np.uint64(1)
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, packed: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to cap, or a little more than each one's end if `ends` tells where that may be."""
    n, out = len(text), np.zeros(len(a), np.int32)
    on = np.arange(len(a))
    if packed is not None:
        # six symbols at a time; a place beyond the end differs from all others
        while len(on):
            x, y = a[on] + out[on], b[on] + out[on]
            inside = (x < n) & (y < n)
            same = inside & (packed[np.minimum(x, n - 1)] == packed[np.minimum(y, n - 1)]) & (np.maximum(x, y) + 6 <= n)
            out[on[same]] += 6
            on = on[same]
            on = on[out[on] < cap]
        on = np.flatnonzero(out < cap)
    while len(on):
        step = 6 if packed is not None else 8
        d = out[on]
        x, y = a[on] + d, b[on] + d
        same = np.ones(len(on), bool)
        more = np.zeros(len(on), np.int32)
        for k in range(step):
            inside = (x + k < n) & (y + k < n)
            same &= inside & (text[np.minimum(x + k, n - 1)] == text[np.minimum(y + k, n - 1)])
            more += same
        out[on] = d + more
        on = on[same & (out[on] < (cap if ends is None else ends[on]))]
    return np.minimum(out, cap)


class Floor:
    """The least value read since a given time, for any number of symbols: a stack of suffix minima."""

    def __init__(self):
        self.times: list[int] = []
        self.values: list[int] = []
        self.now = 0

    def add(self, least: int) -> None:
        self.now += 1
        while self.values and self.values[-1] >= least:
            self.values.pop()
            self.times.pop()
        self.values.append(least)
        self.times.append(self.now)

    def since(self, time: int) -> int:
        k = bisect.bisect_right(self.times, time)
        return self.values[k] if k < len(self.values) else 1 << 30


def _sweep(text, is_s, cap, seeds, seed_lcp, up, first, sink) -> None:
    """One sweep in memory. Seeds come in the order of the sweep, with the common prefix to the seed before.

    first: a position to begin with, the least of its symbol, or None. sink(pos, lcp)
    gets everything read, in order. Of one symbol, what was induced is read before
    the seeds: upwards L comes before S, downwards S before L.
    """
    queue, floor, last = Queue(), Floor(), -1
    told: dict[int, tuple[int, int]] = {}  # by symbol: time of its last tuple, least value read after it in that run
    cuts = np.flatnonzero(np.diff(text[seeds])) + 1 if len(seeds) else np.zeros(0, np.int64)
    groups = {int(text[s[0]]): (s, v) for s, v in zip(np.split(seeds, cuts), np.split(seed_lcp, cuts), strict=True) if len(s)}
    heap = [c if up else -c for c in groups]
    if first is not None:
        c = int(text[first])
        queue.push(c, np.array([first], np.int64), np.array([-1], np.int32))
        told[c] = (0, 0)
        heap.append(c)
    heap = sorted(set(heap))
    queued = set(heap)

    def read(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal last
        if lcp[0] < 0:
            lcp = lcp.copy()
            lcp[0] = _common(text, np.array([last]), pos[:1], cap)[0] if last >= 0 else 0
        last = int(pos[-1])
        sink(pos, lcp)
        before = np.maximum(pos - 1, 0)
        ok = (pos > 0) & (np.asarray(is_s[before]) != up)
        took = np.flatnonzero(ok)
        symbol = np.asarray(text[before[took]])
        order = np.argsort(symbol, kind="stable")
        symbol, where = symbol[order], took[order]
        cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for at in np.split(where, cut) if len(where) else []:
            c = int(text[before[at[0]]])
            starts = np.concatenate([[0], at[:-1] + 1])
            least = np.minimum.reduceat(lcp, starts)
            least[-1] = lcp[starts[-1] : at[-1] + 1].min()
            new = np.minimum(least + 1, cap).astype(np.int32)
            if c in told:
                new[0] = min(int(least[0]), told[c][1], floor.since(told[c][0])) + 1
                new[0] = min(new[0], cap)
            else:
                new[0] = -1
            queue.push(c, before[at], new)
            rest = lcp[at[-1] + 1 :]
            told[c] = (floor.now + 1, int(rest.min()) if len(rest) else 1 << 30)
            k = c if up else -c
            if k not in queued:
                heapq.heappush(heap, k)
                queued.add(k)
        floor.add(int(lcp.min()))

    while heap:
        k = heapq.heappop(heap)
        c = k if up else -k
        while (item := queue.pop(c)) is not None:
            read(*item)
        queued.discard(k)
        if c in groups:
            pos, lcp = groups.pop(c)
            lcp = lcp.copy()
            lcp[0] = -1
            read(pos, lcp)


@dataclass
class Tally:
    """What a sort has done: strings sorted by sweeps over files, depth of the recursion, tuples put on disk."""

    levels: int = 0
    spilled: int = 0


class Spool:
    """Numbers in a file: appended piece by piece, then read anywhere."""

    def __init__(self, folder: str, kind: type):
        self.kind, self.n = np.dtype(kind), 0
        self.file = tempfile.NamedTemporaryFile(dir=folder, delete=False)

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.n += len(values)

    def array(self) -> np.ndarray:
        """All numbers, mapped from the file."""
        self.file.flush()
        return np.memmap(self.file.name, self.kind, "r+", shape=(self.n,)) if self.n else np.zeros(0, self.kind)

    def drop(self) -> None:
        self.file.close()
        os.unlink(self.file.name)


class TupleQueue:
    """A priority queue of (symbol, position, common prefix), first in first out for each symbol.

    Sorted runs; neighbours of like size are merged, the older one first. Runs of more
    than `memory` tuples together go to a file. Symbols are read upwards or downwards.
    """

    def __init__(self, folder: str, memory: int, up: bool, tally: Tally):
        self.folder, self.memory, self.sign, self.tally = folder, memory, 1 if up else -1, tally
        self.disk: list[list] = []  # [symbols, positions, prefixes, place, the files]
        self.runs: list[list] = []  # [symbols, positions, prefixes, place]
        self.held = 0

    @staticmethod
    def _sorted(parts: list[list]) -> list:
        cols = [np.concatenate([p[i][p[3] :] for p in parts]) for i in range(3)]
        order = np.argsort(cols[0], kind="stable")
        return [*(c[order] for c in cols), 0]

    def push(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        key = symbol.astype(np.int64) * self.sign
        self.runs.append(self._sorted([[key, pos, lcp, 0]]) if len(key) > 1 and (key[1:] < key[:-1]).any() else [key, pos, lcp, 0])
        self.held += len(pos)
        size = lambda r: len(r[0]) - r[3]
        while len(self.runs) > 1 and size(self.runs[-2]) <= 2 * size(self.runs[-1]):
            self.runs[-2:] = [self._sorted(self.runs[-2:])]
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        key, pos, lcp, _ = self._sorted(self.runs)
        files = [Spool(self.folder, t) for t in (np.int64, np.int64, np.int32)]
        for f, x in zip(files, (key, pos, lcp), strict=True):
            f.append(x)
        self.disk.append([*(f.array() for f in files), 0, files])
        self.tally.spilled += len(key)
        self.runs, self.held = [], 0

    def least(self) -> int | None:
        """The symbol that comes next."""
        heads = [int(r[0][r[3]]) for r in (*self.disk, *self.runs)]
        return min(heads) * self.sign if heads else None

    def pop(self, symbol: int, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of the symbol that comes next, `most` at most."""
        key = symbol * self.sign
        for group in (self.disk, self.runs):
            for k, r in enumerate(group):
                at = r[3]
                if r[0][at] != key:
                    continue
                n = int(np.searchsorted(r[0][at : at + most], key, "right"))
                out = np.array(r[1][at : at + n]), np.array(r[2][at : at + n])
                r[3] += n
                if group is self.runs:
                    self.held -= n
                if r[3] == len(r[0]):
                    if group is self.disk:
                        for f in r[4]:
                            f.drop()
                    del group[k]
                return out
        return None

    def close(self) -> None:
        for r in self.disk:
            for f in r[4]:
                f.drop()


def _swept(text, is_s, cap: int, given: TupleQueue, queue: TupleQueue, up: bool, first: int | None, sink, carried: bool) -> None:
    """A sweep as :func:`_sweep` does it, from queue to sink. carried: common prefixes are wanted too, of a text of few symbols."""
    floor, last = Floor(), -1
    told: dict[int, tuple[int, int]] = {}
    if first is not None:
        queue.push(np.asarray(text[first : first + 1]), np.array([first], np.int64), np.array([-1], np.int32))
        told[int(text[first])] = (0, 0)

    def read(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal last
        if carried and lcp[0] < 0:
            lcp[0] = _common(text, np.array([last]), pos[:1], cap)[0] if last >= 0 else 0
        last = int(pos[-1])
        sink(pos, lcp)
        before = np.maximum(pos - 1, 0)
        took = np.flatnonzero((pos > 0) & (np.asarray(is_s[before]) != up))
        symbol = np.asarray(text[before[took]])
        if not carried:
            queue.push(symbol, before[took], np.zeros(len(took), np.int32))
            return
        new = np.empty(len(took), np.int32)
        order = np.argsort(symbol, kind="stable")
        cut = np.flatnonzero(symbol[order][1:] != symbol[order][:-1]) + 1
        for ix in np.split(order, cut) if len(order) else []:
            c, at = int(symbol[ix[0]]), took[ix]
            starts = np.concatenate([[0], at[:-1] + 1])
            least = np.minimum.reduceat(lcp, starts)
            least[-1] = lcp[starts[-1] : at[-1] + 1].min()
            new[ix] = np.minimum(least + 1, cap)
            new[ix[0]] = min(min(int(least[0]), told[c][1], floor.since(told[c][0])) + 1, cap) if c in told else -1
            rest = lcp[at[-1] + 1 :]
            told[c] = (floor.now + 1, int(rest.min()) if len(rest) else 1 << 30)
        queue.push(symbol, before[took], new)
        floor.add(int(lcp.min()))

    while True:
        heads = [x for x in (queue.least(), given.least()) if x is not None]
        if not heads:
            break
        c = min(heads) if up else max(heads)
        while queue.least() == c:
            read(*queue.pop(c))
        begun = False
        while given.least() == c:
            pos, lcp = given.pop(c)
            if not begun:
                lcp[0], begun = -1, True
            read(pos, lcp)
    queue.close()
    given.close()


def _two_sweeps(text, is_s, cap: int, folder: str, memory: int, tally: Tally, seeds, sink, carried: bool) -> None:
    """Both sweeps from seeds, pieces (positions, common prefixes) in order; sink gets all suffixes, the greatest first."""
    queue = lambda up: TupleQueue(folder, memory, up, tally)
    given = queue(True)
    for pos, lcp in seeds:
        given.push(np.asarray(text[pos]), pos, lcp)
    lefts, prefixes, least = Spool(folder, np.int64), Spool(folder, np.int32), 1 << 30

    def keep(pos: np.ndarray, lcp: np.ndarray) -> None:
        """L suffixes, each with the least common prefix since the one before."""
        nonlocal least
        at = np.flatnonzero(~np.asarray(is_s[pos]))
        if len(at):
            starts = np.concatenate([[0], at[:-1] + 1])
            mins = np.minimum.reduceat(lcp, starts)
            mins[-1] = lcp[starts[-1] : at[-1] + 1].min()
            mins[0] = min(int(mins[0]), least)
            lefts.append(pos[at])
            prefixes.append(mins)
            least = 1 << 30
        rest = lcp[at[-1] + 1 if len(at) else 0 :]
        if len(rest):
            least = min(least, int(rest.min()))

    _swept(text, is_s, cap, given, queue(True), True, len(text) - 1, keep, carried)
    pos, lcp, given = lefts.array(), prefixes.array(), queue(False)
    for hi in range(len(pos), 0, -CHUNK):
        lo = max(0, hi - CHUNK)
        after = np.append(lcp[lo + 1 : hi], lcp[hi] if hi < len(lcp) else 0)
        p = np.array(pos[lo:hi][::-1])
        given.push(np.asarray(text[p]), p, np.ascontiguousarray(after[::-1], np.int32))
    lefts.drop()
    prefixes.drop()
    _swept(text, is_s, cap, given, queue(False), False, None, sink, carried)


def _pieces(n: int):
    for at in range(0, n, CHUNK):
        yield at, min(n, at + CHUNK)


def descending(text: np.ndarray, cap: int, folder: str, *, memory: int = 4 << 20, in_memory: int = 1 << 22, tally: Tally | None = None, carried: bool = True) -> tuple[Spool, Spool]:
    """Files of all suffixes of a string of numbers from 0 on, the greatest first, and of each one's common prefix with the one before, up to cap.

    carried: whether the common prefixes are wanted. The text may be mapped from a file.
    """
    tally = tally or Tally()
    n = len(text)
    out, prefixes = Spool(folder, np.int64), Spool(folder, np.int32)
    if n <= max(in_memory, 1):
        sa, lcp = suffix_array(np.asarray(text), cap)
        out.append(sa[::-1])
        prefixes.append(np.append(0, lcp[1:][::-1]) if n else lcp)
        return out, prefixes
    tally.levels += 1
    with tempfile.TemporaryDirectory(dir=folder) as tmp:
        is_s = np.memmap(f"{tmp}/types", bool, "w+", shape=(n,))
        types_of(text, is_s)
        stars = Spool(tmp, np.int64)
        for lo, hi in _pieces(n - 1):
            here = np.asarray(is_s[lo : hi + 1])
            stars.append(np.flatnonzero(here[1:] & ~here[:-1]) + lo + 1)
        star = stars.array()
        order = _seed_order(text, is_s, star, tmp, memory, in_memory, tally)

        def seeds():
            last = None
            for lo, hi in _pieces(len(order)):
                pos = np.array(star[np.asarray(order[lo:hi])])
                lcp = np.zeros(len(pos), np.int32)
                if carried:
                    prior = np.append(pos[:1] if last is None else last, pos[:-1])
                    lcp = _common(text, prior, pos, cap)
                last = pos[-1:]
                yield pos, lcp

        def sink(pos: np.ndarray, lcp: np.ndarray) -> None:
            out.append(pos)
            prefixes.append(lcp)

        _two_sweeps(text, is_s, cap, tmp, memory, tally, seeds(), sink, carried)
    return out, prefixes


def _seed_order(text, is_s, star, folder: str, memory: int, in_memory: int, tally: Tally) -> np.ndarray:
    """The seeds' places in the text's order of seeds, the least suffix first."""
    m, n = len(star), len(text)
    if m <= 1:
        return np.arange(m)
    # sorted by the substrings up to the next seed: two sweeps over seeds in any order
    found = Spool(folder, np.int64)

    def keep(pos: np.ndarray, lcp: np.ndarray) -> None:
        ok = (pos > 0) & np.asarray(is_s[pos]) & ~np.asarray(is_s[np.maximum(pos - 1, 0)])
        found.append(pos[ok])

    _two_sweeps(text, is_s, 0, folder, memory, tally, ((np.array(star[lo:hi]), np.zeros(hi - lo, np.int32)) for lo, hi in _pieces(m)), keep, False)
    by = found.array()[::-1]
    # names, written at the place of each seed in the text
    names = np.memmap(f"{folder}/names", np.int64, "w+", shape=(m,))
    places = np.memmap(f"{folder}/places", np.int64, "w+", shape=(m,))
    name, last = -1, None
    for lo, hi in _pieces(m):
        pos = np.array(by[lo:hi])
        at = np.searchsorted(star, pos)
        size = np.where(at + 1 < m, star[np.minimum(at + 1, m - 1)] + 1, n + 1) - pos
        prior = (pos[:1] - 1, size[:1] * 0) if last is None else last
        a, na = np.append(prior[0], pos[:-1]), np.append(prior[1], size[:-1])
        same = na == size
        same[same] = _common(text, a[same], pos[same], int(size[same].max(initial=0)), ends=size[same]) >= np.minimum(size[same], n - pos[same])
        # a substring that ends with the text is equal to none
        same &= at + 1 < m
        which = name + np.cumsum(~same)
        names[at], places[lo:hi] = which, at
        name, last = int(which[-1]), (pos[-1:], size[-1:])
    found.drop()
    if name + 1 == m:
        return places
    deeper, none = descending(names, 0, folder, memory=memory, in_memory=in_memory, tally=tally, carried=False)
    none.drop()
    return deeper.array()[::-1]


def suffix_array(text: np.ndarray, cap: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """In memory: suffix array of a string of numbers from 0 on, and each suffix's common prefix with the one before, up to cap."""
    n = len(text)
    if n <= 1:
        return np.arange(n), np.zeros(n, np.int32)
    is_s = np.empty(n, bool)
    types_of(text, is_s)
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order = _sort_seeds(text, is_s, star, cap)
    seeds = star[order]
    lcp = np.zeros(len(seeds), np.int32)
    if cap and len(seeds) > 1:
        lcp[1:] = _common(text, seeds[:-1], seeds[1:], cap, _packed(text))
    # upwards; the last position is induced by the end of the text, before all others of its symbol
    lefts: list[tuple[np.ndarray, np.ndarray]] = []
    _sweep(text, is_s, cap, seeds, lcp, True, n - 1, lambda p, v: lefts.append((p, v)))
    pos = np.concatenate([p for p, _ in lefts]) if lefts else np.zeros(0, np.int64)
    is_l = ~is_s[pos]
    pos = pos[is_l]
    # downwards: all L suffixes, greatest first
    down = pos[::-1]
    down_lcp = np.zeros(len(down), np.int32)
    if len(down) > 1:
        down_lcp[1:] = _between(np.concatenate([v for _, v in lefts]), is_l)[::-1]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    _sweep(text, is_s, cap, down, down_lcp, False, None, lambda p, v: out.append((p, v)))
    sa = np.concatenate([p for p, _ in out])[::-1]
    v = np.concatenate([x for _, x in out])
    back = np.zeros(n, np.int32)
    back[1:] = v[1:][::-1]
    return sa, back


def _between(lcp: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours among the kept ones."""
    at = np.flatnonzero(keep)
    if len(at) < 2:
        return np.zeros(0, np.int32)
    starts = at[:-1] + 1
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, at[1:] + 1
    ends_inside = bounds[-1] < len(lcp)
    got = np.minimum.reduceat(lcp, bounds if ends_inside else bounds[:-1])
    return got[0::2].astype(np.int32)


def _sort_seeds(text, is_s, star, cap) -> np.ndarray:
    """In memory: the order of the seed suffixes, by the names of their substrings."""
    m = len(star)
    if m <= 1:
        return np.arange(m)
    n = len(text)
    length = np.append(star[1:], n) - star + 1
    length[-1] = n - star[-1]
    # names: sort the substrings symbol by symbol, dropping those that stand alone
    name = np.zeros(m, np.int64)
    group = np.arange(m)
    depth = 0
    while len(group):
        keys = [name[group]]
        for k in range(depth, depth + 6):
            at = star[group] + k
            inside = k < length[group]
            at = np.minimum(at, n - 1)
            # of equal symbols the one of type L is smaller
            sym = np.where(inside, 2 * text[at].astype(np.int64) + is_s[at] + 1, 0)
            keys.append(sym)
        order = np.lexsort(keys[::-1])
        diff = np.zeros(len(group), bool)
        for key in keys:
            s = key[order]
            diff[1:] |= s[1:] != s[:-1]
        old = name[group][order]
        fresh = np.ones(len(group), bool)
        fresh[1:] = old[1:] != old[:-1]
        # names stay spaced by the size of their group, so that groups can be split in place
        rank = np.arange(len(group))
        begin = np.maximum.accumulate(np.where(fresh, rank, 0))
        split = np.maximum.accumulate(np.where(diff | fresh, rank, 0))
        name[group[order]] = old + (split - begin)
        depth += 6
        size = np.diff(np.append(np.flatnonzero(diff | fresh), len(group)))
        alone = np.repeat(size == 1, size)
        done = length[group[order]] <= depth
        group = group[order][~alone & ~done]
    if len(np.unique(name)) == m:
        return np.argsort(name)
    return _by_doubling(np.unique(name, return_inverse=True)[1], -(-cap // 2) if cap else m)


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names that fits in memory, in the order of their first `depth` names at least."""
    m, h = len(names), 1
    rank = names.astype(np.int64)
    while True:
        second = np.concatenate([rank[h:] + 1, np.zeros(min(h, m), np.int64)])[:m]
        key = rank * (m + 2) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(m, np.int64)
        rank[order] = new
        h *= 2
        if new[-1] == m - 1 or h >= max(depth, 1):
            return order
