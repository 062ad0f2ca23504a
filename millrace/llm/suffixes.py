"""External suffix sorting of one shard by induction, with common-prefix values, in numpy.

The text's leftmost-S suffixes are sorted first: their substrings are sorted by an induction of their own and named,
and the string of names is sorted in turn, by recursion or, once it is short, in memory. From them all other suffixes
are induced: suffixes are taken from a priority queue in ascending order and put the L-type suffix before them in,
then in descending order for the S-type ones. A queue orders by first character and, within one, by arrival, which is
what induction needs of a priority queue; it keeps a bounded number of entries in memory and appends the rest to a file,
from which they come back a bounded number at a time. Entries are (position, common prefix with the entry before), the
latter cut off at `cap`: the value of two induced neighbours is one more than the least value between their sources,
tracked per character and, within a batch, by a table of minima over powers of two.

Nothing that is as long as the text is held in memory: the text, its types, the leftmost-S suffixes, their names and their
order are arrays in files, gone through in pieces of `_CHUNK`. What grows with the text in memory is one entry per
different character, which are 256 for a text and the different names for a string of names.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from heapq import heappop, heappush

import numpy as np

#: Pairs of suffixes that are compared at a time.
_PAIRS = 8192
#: Elements of an array in a file that are worked on at a time.
_CHUNK = 1 << 18
#: Entries that a queue holds before it appends to its file.
MEMORY = 200_000
#: Longest string of names that is sorted in memory.
BASE = 500_000


def scratch() -> tempfile.TemporaryDirectory:
    """A folder for spills of one task, in Spark's own scratch space; no other task reads it and it goes with the task."""
    top = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
    return tempfile.TemporaryDirectory(prefix="suffixes-", dir=top if top and os.path.isdir(top) else None, ignore_cleanup_errors=True)


def array(folder: str, n: int, dtype) -> np.ndarray:
    """An array in a file that goes with the last reference to it."""
    if not n:
        return np.zeros(0, dtype)
    with tempfile.TemporaryFile(dir=folder) as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=(n,)))


def _index(n: int) -> np.dtype:
    return np.dtype(np.int32 if n < 1 << 31 else np.int64)


def _chunks(n: int):
    return ((a, min(n, a + _CHUNK)) for a in range(0, n, _CHUNK))


class _Walk:
    """Characters in ascending (sign 1) or descending order (sign -1), as they turn up; new ones only appear ahead."""

    def __init__(self, sign: int):
        self.sign, self.heap, self.at = sign, [], None

    def add(self, key: int) -> None:
        heappush(self.heap, self.sign * key)

    def next(self) -> int | None:
        while self.heap:
            key = heappop(self.heap)
            if self.at is None or key > self.at:
                self.at = key
                return self.sign * key
        return None


class Queue:
    """Disk-backed priority queue by character; entries of a character come out in the order in which they went in."""

    def __init__(self, folder: str, dtype: np.dtype, memory: int, *walks: _Walk):
        self.dtype, self.memory, self.walks, self.size = dtype, memory, walks, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, deque] = {}
        self.file = tempfile.TemporaryFile(dir=folder)

    def push(self, key: int, entries: np.ndarray) -> None:
        if key not in self.held:
            self.held[key] = []
            if key not in self.spilled:
                for walk in self.walks:
                    walk.add(key)
        self.held[key].append(entries)
        self.size += len(entries)
        if self.size > self.memory:
            self.spill()

    def spill(self) -> None:
        at = self.file.seek(0, os.SEEK_END)
        for key, parts in self.held.items():
            n = 0
            for p in parts:
                self.file.write(p.tobytes())
                n += len(p)
            self.spilled.setdefault(key, deque()).append((at, n))
            at += n * self.dtype.itemsize
        self.held, self.size = {}, 0

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * self.dtype.itemsize), self.dtype)

    def _unhold(self, key: int) -> np.ndarray:
        parts = self.held.pop(key, [])
        self.size -= sum(map(len, parts))
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, self.dtype)

    def pop(self, key: int) -> np.ndarray:
        """The oldest entries of a character, of many not all at once."""
        parts, got, size = self.spilled.get(key), [], 0
        while parts and size < self.memory:
            at, n = parts.popleft()
            take = min(n, self.memory - size)
            got.append(self._read(at, take))
            size += take
            if take < n:
                parts.appendleft((at + take * self.dtype.itemsize, n - take))
        if not parts:
            self.spilled.pop(key, None)
            if size < self.memory:
                got.append(self._unhold(key))
        return np.concatenate(got) if len(got) > 1 else got[0]

    def drain(self, key: int) -> np.ndarray:
        """All entries of a character."""
        parts = []
        while len(part := self.pop(key)):
            parts.append(part)
        return np.concatenate(parts) if parts else np.empty(0, self.dtype)

    def pop_last(self, key: int) -> np.ndarray:
        """The newest entries of a character, of many not all at once, oldest first."""
        if key in self.held:
            return self._unhold(key)
        if not (parts := self.spilled.get(key)):
            return np.empty(0, self.dtype)
        at, n = parts.pop()
        if n > self.memory:
            parts.append((at, n - self.memory))
            at, n = at + (n - self.memory) * self.dtype.itemsize, self.memory
        if not parts:
            del self.spilled[key]
        return self._read(at, n)


def types(t: np.ndarray, folder: str) -> np.ndarray:
    """True where the suffix is of S-type (smaller than the next one); the end of the text is smaller than all."""
    out, after, kind = array(folder, len(t), bool), -1, False
    for a, b in reversed(list(_chunks(len(t)))):
        x = t[a:b].astype(np.int64)
        step = np.sign(np.r_[x[1:], after] - x)
        place = np.where(step != 0, np.arange(len(x)), len(x))
        first = np.minimum.accumulate(place[::-1])[::-1]
        out[a:b] = np.where(first < len(x), step[np.minimum(first, len(x) - 1)] > 0, kind)
        after, kind = int(x[0]), bool(out[a])
    return out


def _stars(s: np.ndarray, folder: str) -> np.ndarray:
    """Positions of the leftmost-S suffixes."""
    with tempfile.TemporaryFile(dir=folder) as f:
        n = 0
        for a, b in _chunks(len(s)):
            own = np.flatnonzero(s[a:b] & ~np.r_[s[a - 1] if a else True, s[a : b - 1]]) + a
            f.write(own.astype(_index(len(s))).tobytes())
            n += len(own)
        f.flush()
        return np.asarray(np.memmap(f, _index(len(s)), "r", shape=(n,))) if n else np.zeros(0, _index(len(s)))


def _by_first(t: np.ndarray, star: np.ndarray, folder: str) -> np.ndarray:
    """Positions by their character, those of one in order of the text: a counting sort."""
    out, space = array(folder, len(star), star.dtype), np.zeros(int(t.max()) + 2, np.int64)
    for a, b in _chunks(len(star)):
        np.add.at(space, t[star[a:b]].astype(np.int64) + 1, 1)
    space = np.cumsum(space)
    for a, b in _chunks(len(star)):
        c = t[star[a:b]].astype(np.int64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        n = np.diff(np.r_[first, len(c)])
        out[space[c] + np.arange(len(c)) - np.repeat(first, n)] = star[a:b][order]
        space[c[first]] += n
    return out


class _Least:
    """Least common-prefix value since the last entry that went to each character."""

    def __init__(self, cap: int, size: int):
        self.cap, self.since, self.fresh = cap, np.full(size, cap, np.int32), np.ones(size, bool)

    def values(self, lcp: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """For a batch with values `lcp`, of which entries `at` send one to character `to`: the values sent."""
        m = len(lcp)
        prefix = np.minimum.accumulate(lcp)
        out = np.empty(len(at), np.int32)
        order = np.argsort(to, kind="stable")
        k, c = at[order], to[order]
        first = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
        if len(k):
            got = np.minimum(self.since[c], prefix[k])
            inner = np.flatnonzero(~first)
            if len(inner):
                got[inner] = _range_min(lcp, k[inner - 1] + 1, k[inner])
            got = np.minimum(got + 1, self.cap)
            got[first & self.fresh[c]] = 0
            out[order] = got
        self.since = np.minimum(self.since, prefix[-1])
        if len(k):
            last = np.r_[first[1:], True]
            after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], self.cap]
            self.since[c[last]] = after[np.minimum(k[last] + 1, m)]
            self.fresh[c[last]] = False
        return out


def _range_min(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of v[a..b], both included, for many ranges; ranges of one width class share one row of minima."""
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    out, row = np.empty(len(a), v.dtype), v
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(row[a[own]], row[b[own] - (1 << k) + 1])
    return out


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a[k] and b[k], up to `cap`; the text ends differ from all characters."""
    if len(a) > _PAIRS:
        return np.concatenate([common(t, a[k : k + _PAIRS], b[k : k + _PAIRS], cap) for k in range(0, len(a), _PAIRS)])
    out = np.zeros(len(a), np.int32)
    room = np.minimum(np.minimum(len(t) - a, len(t) - b), cap)
    left = np.flatnonzero(room > 0)
    width = 8
    while len(left):
        span = np.arange(width)
        p = np.minimum(a[left, None] + out[left, None] + span, len(t) - 1)
        q = np.minimum(b[left, None] + out[left, None] + span, len(t) - 1)
        same = t[p] == t[q]
        run = np.where(same.all(1), width, same.argmin(1))
        out[left] += run
        on = (run == width) & (out[left] < room[left])
        out[left] = np.minimum(out[left], room[left])
        left = left[on]
        width = min(64, width * 2)
    return out


class _Induction:
    def __init__(self, t: np.ndarray, s: np.ndarray, folder: str, memory: int, cap: int | None):
        self.t, self.s, self.folder, self.memory, self.cap = t, s, folder, memory, cap
        at = _index(len(t))
        self.dtype = np.dtype([("at", at)] if cap is None else [("at", at), ("lcp", np.uint16 if cap < 1 << 16 else np.int32)])

    def _least(self) -> _Least | None:
        return _Least(self.cap, int(self.t.max()) + 1) if self.cap is not None else None

    def _send(self, queue: Queue, batch: np.ndarray, least: _Least | None, want_s: bool) -> None:
        """Puts the suffixes before those of the batch in, if they are of the wanted type, in the batch's order."""
        if not len(batch):
            return
        at = np.flatnonzero(batch["at"] > 0)
        before = batch["at"][at] - 1
        own = self.s[before] == want_s
        at, before = at[own], before[own]
        to = self.t[before]
        made = np.empty(len(at), self.dtype)
        made["at"] = before
        if least:
            made["lcp"] = least.values(batch["lcp"].astype(np.int32), at, to.astype(np.int64))
        if len(made):
            order = np.argsort(to, kind="stable")
            to = to[order]
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
            made = made[order]
            for key, a, b in zip(to[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                queue.push(key, made[a:b])

    def _star_ranges(self, stars: np.ndarray) -> dict[int, tuple[int, int]]:
        """For each character the range of `stars` that starts with it."""
        out, start, char = {}, 0, None
        for a, b in _chunks(len(stars)):
            heads = self.t[stars[a:b]]
            cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist()]
            for k, c in zip(cuts, heads[cuts].tolist(), strict=True):
                if c != char:
                    if char is not None:
                        out[char] = (start, a + k)
                    start, char = a + k, c
        if char is not None:
            out[char] = (start, len(stars))
        return out

    def run(self, stars: np.ndarray, lcp: np.ndarray | None):
        """Yields (character, entries) in descending order of suffixes, given the leftmost-S suffixes in ascending order
        (and their values towards the one before). An entry's value is towards the entry yielded before it."""
        t, cap, carry = self.t, self.cap, self.cap is not None
        walk, back = _Walk(1), _Walk(-1)
        up, low = Queue(self.folder, self.dtype, self.memory, walk), Queue(self.folder, self.dtype, self.memory, back)
        least = self._least()
        end = np.zeros(1, self.dtype)
        end["at"] = len(t)
        self._send(up, end, least, False)
        star_of = self._star_ranges(stars)
        for c in star_of:
            walk.add(c)
        while (c := walk.next()) is not None:
            last = -1
            while len(batch := up.pop(c)):
                self._send(up, batch, least, False)
                low.push(c, batch)
                last = int(batch["at"][-1])
            a, b = star_of.get(c, (0, 0))
            for k in range(a, b, self.memory):
                batch = np.empty(min(b, k + self.memory) - k, self.dtype)
                batch["at"] = stars[k : k + len(batch)]
                if carry:
                    batch["lcp"] = lcp[k : k + len(batch)]
                    if k == a:
                        batch["lcp"][0] = common(t, np.array([last]), batch["at"][:1].astype(np.int64), cap)[0] if last >= 0 else 0
                self._send(up, batch, least, False)
        del up
        least, down = self._least(), Queue(self.folder, self.dtype, self.memory, back)
        while (c := back.next()) is not None:
            last, ahead = -1, None
            while len(batch := down.pop(c)):
                self._send(down, batch, least, True)
                last = int(batch["at"][-1])
                yield c, batch
            while len(batch := low.pop_last(c)):
                values = batch["lcp"].copy() if carry else None
                batch = batch[::-1].copy()
                if carry:
                    batch["lcp"][1:] = values[::-1][:-1]
                    if ahead is None:
                        ahead = common(t, np.array([last]), batch["at"][:1].astype(np.int64), cap)[0] if last >= 0 else 0
                    batch["lcp"][0], ahead = ahead, values[0]
                self._send(down, batch, least, True)
                yield c, batch


def _refine(rank: np.ndarray, tied: np.ndarray, hop: np.ndarray) -> np.ndarray:
    """Ranks without ties, by doubling over the `tied` ones: equal ranks are told apart by the rank at `hop`, then at its hop."""
    while len(tied):
        nxt = rank[hop[tied]]
        order = np.lexsort((nxt, rank[tied]))
        tied, nxt = tied[order], nxt[order]
        head = rank[tied]
        group = np.r_[True, head[1:] != head[:-1]]
        new = group | np.r_[True, nxt[1:] != nxt[:-1]]
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(group, place, 0))
        sub = np.maximum.accumulate(np.where(new, place, 0))
        rank[tied] = head + (sub - first)
        size = np.diff(np.r_[np.flatnonzero(new), len(tied)])
        tied = tied[np.repeat(size, size) > 1]
        hop = hop[hop]
    return rank


def _ranks_in_memory(names: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a string of names; the end is smaller than all."""
    n = len(names)
    name = np.unique(names, return_inverse=True)[1]
    count = np.bincount(name)
    rank = np.r_[(np.cumsum(count) - count)[name], -1]
    return _refine(rank, np.flatnonzero(count[name] > 1), np.minimum(np.arange(1, n + 2), n))[:n]


class _NameInduction:
    """Induction over a string of names, whose characters are too many to be taken one by one.

    Queues are by ranges of characters that hold about `memory` suffixes. Within a range, suffixes whose next one is in
    another range come in order from there; the rest form chains within the range, that are sorted by doubling.
    """

    def __init__(self, t: np.ndarray, s: np.ndarray, folder: str, memory: int):
        self.t, self.s, self.folder, self.memory = t, s, folder, memory
        counts = np.zeros(int(t.max()) + 1, np.int64)
        for a, b in _chunks(len(t)):
            np.add.at(counts, t[a:b], 1)
        self.range_of = ((np.cumsum(counts) - counts) // memory).astype(np.int32)

    def _before(self, at: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes before those at `at` that are of the wanted type, from which of them, and their ranges."""
        source = np.flatnonzero(at > 0)
        before = at[source] - 1
        own = self.s[before] == want_s
        return before[own], source[own], self.range_of[self.t[before[own]]]

    def _sorted(self, head: np.ndarray, tail: np.ndarray, r: int, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of a range in order, and whether they are of `tail`. Of a character those of `head`, which come in order from
        other ranges, are first, then those whose next suffix is in the range, then those of `tail`, which are in order."""
        front = np.r_[head, tail]
        at, hop, n = [front], [np.arange(len(front))], len(front)
        place = hop[0]
        while len(front):
            front, source, ranges = self._before(front, want_s)
            own = ranges == r
            front, source = front[own], place[source[own]]
            place = np.arange(n, n + len(front))
            n += len(front)
            at.append(front)
            hop.append(source)
        at, hop = np.concatenate(at), np.concatenate(hop)
        char = self.t[at].astype(np.int64) * (-1 if want_s else 1)
        kind, order = np.ones(n, np.int8), np.zeros(n, np.int64)
        kind[: len(head)], kind[len(head) : len(head) + len(tail)] = 0, 2
        order[: len(head) + len(tail)] = np.arange(len(head) + len(tail))
        by = np.lexsort((order, kind, char))
        new = np.r_[True, (char[by][1:] != char[by][:-1]) | (kind[by][1:] != kind[by][:-1]) | (kind[by][1:] != 1)]
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, n])
        rank = np.empty(n, np.int64)
        rank[by] = np.repeat(starts, size)
        by = np.argsort(_refine(rank, by[np.repeat(size, size) > 1], hop))
        return at[by], kind[by] == 2

    def _send(self, queue: Queue, at: np.ndarray, r: int, want_s: bool) -> None:
        before, _, ranges = self._before(at, want_s)
        before, ranges = before[ranges != r], ranges[ranges != r]
        order = np.argsort(ranges, kind="stable")
        before, ranges = before[order], ranges[order]
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)] if len(ranges) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            queue.push(int(ranges[a]), before[a:b])

    def run(self, stars: np.ndarray):
        """Yields all positions in descending order of suffixes, given the leftmost-S suffixes in ascending order."""
        last, index = int(self.range_of[-1]) + 1, _index(len(self.t))
        ends = np.zeros(last, np.int64)
        for a, b in _chunks(len(stars)):
            ends += np.bincount(self.range_of[self.t[stars[a:b]]], minlength=last)
        ends = np.cumsum(ends)
        up, low, down = (Queue(self.folder, index, self.memory) for _ in range(3))
        end = np.array([len(self.t) - 1], index)
        up.push(int(self.range_of[self.t[end[0]]]), end)
        for r in range(last):
            at, star = self._sorted(up.drain(r), stars[ends[r - 1] if r else 0 : ends[r]], r, False)
            if len(at):
                low.push(r, at[~star])
                self._send(up, at, r, False)
        for r in reversed(range(last)):
            at, _ = self._sorted(down.drain(r), low.drain(r)[::-1], r, True)
            if len(at):
                yield at
                self._send(down, at, r, True)


def _names(t: np.ndarray, star: np.ndarray, by_part: np.ndarray, folder: str) -> tuple[np.ndarray, int]:
    """Name of each leftmost-S suffix, the place of its substring up to the next one among the different ones, and their number."""
    m, n = len(star), len(t)
    names, count = array(folder, m, _index(m)), 0
    for start, b in _chunks(m):
        part = by_part[max(0, start - 1) : b].astype(np.int64)
        k = np.searchsorted(star, part)
        length = np.where(k + 1 < m, star[np.minimum(k + 1, m - 1)].astype(np.int64), n) - part + 1  # the last one runs into the end and is like no other
        p, q = part[:-1], part[1:]
        same = np.zeros(len(p), bool)
        fit = np.flatnonzero(length[:-1] == length[1:])
        want = length[:-1][fit]
        for w in np.unique(want):
            own = fit[want == w]
            same[own] = common(t, p[own], q[own], int(w)) >= w
        made = np.cumsum(~same) + count
        if start:
            names[k[1:]] = made
        else:
            names[k] = np.r_[0, made]
        count = int(made[-1]) if len(made) else count
    return names, count + 1


def _star_order(t: np.ndarray, s: np.ndarray, folder: str, memory: int, base: int) -> np.ndarray:
    """Positions of the leftmost-S suffixes, sorted."""
    star = _stars(s, folder)
    m = len(star)
    if m < 2:
        return star
    by_part, place = array(folder, m, star.dtype), m  # sorted by their substrings up to the next star
    rough = _by_first(t, star, folder)
    if t.dtype == np.uint8:
        sorted_parts = (batch["at"] for _, batch in _Induction(t, s, folder, memory, None).run(rough, None))
    else:
        sorted_parts = _NameInduction(t, s, folder, memory).run(rough)
    for at in sorted_parts:
        at = at[at > 0]
        at = at[s[at] & ~s[at - 1]]
        by_part[place - len(at) : place] = at[::-1]
        place -= len(at)
    names, different = _names(t, star, by_part, folder)
    if different == m:
        return by_part
    out = by_part  # its order is in the names
    if m <= base:
        out[_ranks_in_memory(np.asarray(names))] = star
        return out
    kinds, place = types(names, folder), m
    for at in _NameInduction(names, kinds, folder, memory).run(_star_order(names, kinds, folder, memory, base)):
        out[place - len(at) : place] = star[at][::-1]
        place -= len(at)
    return out


def suffixes(t: np.ndarray, folder: str, *, cap: int, memory: int = MEMORY, base: int = BASE):
    """Yields arrays (position, common prefix with the suffix yielded before, up to `cap`), all suffixes in descending order.

    `memory`: entries that each queue holds before it appends to its file; `base`: longest string of names sorted in memory.
    """
    if not len(t):
        return
    s = types(t, folder)
    stars = _star_order(t, s, folder, memory, base)
    lcp = array(folder, len(stars), np.uint16 if cap < 1 << 16 else np.int32)
    for a, b in _chunks(len(stars)):
        part = stars[max(0, a - 1) : b].astype(np.int64)
        values = common(t, part[:-1], part[1:], cap)
        lcp[a:b] = values if a else np.r_[0, values]
    for _, batch in _Induction(t, s, folder, memory, cap).run(stars, lcp):
        yield batch["at"], batch["lcp"]
