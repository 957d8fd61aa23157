"""Suffix arrays with common-prefix values by induced sorting in files, for shards larger than memory.

The suffixes at left-most S positions, the seeds, are sorted first: the substrings from one seed to the next are dealt by
their first symbols into ranges that fit in memory, sorted and named there, and where names repeat the string of names is
sorted the same way, by recursion, half as deep each time. From the seeds the L suffixes are induced in one ascending scan,
and from these the S suffixes in one descending scan. A scan takes tuples from a priority queue by their symbol and then by
order of arrival, and pushes the suffix one place to the left of each. With every tuple the bottom level's queue carries the
length of the prefix that it shares with the tuple pushed before it under the same symbol: one more than the least such value
among the suffixes scanned between their parents.

Scanned batches are whole arrays. The queues are lists of runs sorted by symbol, which go to files once they hold more than
their memory, and so do texts, types, seeds, names and results above SMALL bytes; the files are nameless and in the task's own
work folder, as a task that is run again makes them anew. In memory are batches, and the items of one symbol of a recursion
level where there are more of them than a batch has.

Orders and values are right as far as depth symbols; values above depth only say that it is reached.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples that a queue keeps in memory, items of a batch, bytes of an array that stays in memory.
QUEUE_MEMORY, BATCH, SMALL = 1 << 18, 1 << 16, 1 << 24
_ZERO = np.zeros(1, np.int64)


def scratch(n: int, kind: type) -> np.ndarray:
    """n values, zero at first, in a file if they are many."""
    if n * np.dtype(kind).itemsize <= SMALL:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, BATCH):
        yield a, min(a + BATCH, n)


def _gathered(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The parts, small ones put together."""
    out, held = [], 0
    for part in parts:
        if not held or held + len(part[0]) > BATCH:
            out.append([])
            held = 0
        out[-1].append(part)
        held += len(part[0])
    return [tuple(np.concatenate(x) for x in zip(*group)) if len(group) > 1 else group[0] for group in out]


class DiskQueue:
    """Tuples (symbol, position, shared), taken by ranges of symbols and, under one symbol, in the order in which they came."""

    def __init__(self, memory: int | None = None):
        self.memory = QUEUE_MEMORY if memory is None else memory
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.ends: list[list[int]] = []  # of the symbols in each run, where they are bytes
        self.tops: list[int] = []
        self.held = self.spilled = 0
        self.file = None

    def push(self, symbol: np.ndarray, position: np.ndarray, shared: np.ndarray | None = None) -> None:
        """Tuples sorted by symbol."""
        self.runs.append((symbol, position) if shared is None else (symbol, position, shared))
        self.tops.append(int(symbol[-1]))
        self.ends.append(np.cumsum(np.bincount(symbol, minlength=256)).tolist() if symbol.dtype == np.uint8 else [])
        self.held += len(position)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for k, run in enumerate(self.runs):
            if not isinstance(run[1], np.memmap):
                views = []
                for x in run:
                    at = self.file.seek(0, 2)
                    self.file.write(x.tobytes())
                    views.append((x.dtype, at, x.shape))
                self.file.flush()
                self.runs[k] = tuple(np.memmap(self.file, kind, "r", at, shape) for kind, at, shape in views)
        self.spilled += self.held
        self.held = 0

    def take(self, low: int, high: int, seen: int = 0) -> tuple[int, list[tuple[np.ndarray, ...]]]:
        """The tuples under low to high - 1 of the runs from number seen on, some runs at a time; and how many runs there are.
        Symbols are taken in rising order, so runs below low are let go."""
        out = []
        for k in range(seen, len(self.runs)):
            if self.tops[k] >= low:
                if self.ends[k]:
                    a, b = self.ends[k][low - 1] if low else 0, self.ends[k][high - 1]
                else:
                    a, b = np.searchsorted(self.runs[k][0], [low, high])
                if b > a:
                    out.append(tuple(x[a:b] for x in self.runs[k]))
        if not seen and len(self.runs) > 64 and sum(t < low for t in self.tops) > len(self.runs) // 2:
            kept = [k for k, t in enumerate(self.tops) if t >= low]
            self.runs, self.tops, self.ends = ([x[k] for k in kept] for x in (self.runs, self.tops, self.ends))
        return len(self.runs), _gathered(out)

    def close(self) -> None:
        self.runs.clear()
        if self.file is not None:
            self.file.close()


def types(s: np.ndarray, last: bool) -> np.ndarray:
    """Which suffixes are smaller than the one after them (S); last says it of the last one."""
    n = len(s)
    out = scratch(n, bool)
    out[n - 1] = carry = last
    for a in range((n - 2) // BATCH * BATCH, -1, -BATCH):
        x = s[a : min(a + BATCH, n - 1) + 1]
        at = np.where(x[:-1] != x[1:], np.arange(len(x) - 1), len(x) - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a : a + len(at)] = np.append(x[:-1] < x[1:], carry)[at]
        carry = out[a]
    return out


def leftmost(small: np.ndarray) -> np.ndarray:
    """Places of S suffixes to the right of L suffixes."""
    out, done = None, 0
    for pass_ in (0, 1):
        for a, b in _blocks(len(small)):
            at = np.flatnonzero(small[a + 1 : b + 1] & ~small[a : min(b, len(small) - 1)])
            if pass_:
                out[done : done + len(at)] = at + a + 1
            done += len(at)
        if not pass_:
            out, done = scratch(done, np.int32), 0
    return out


def _each(x: np.ndarray, kind: type, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    out = scratch(len(x), kind)
    for a, b in _blocks(len(x)):
        out[a:b] = f(x[a:b])
    return out


def _first(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By what seeds are dealt to ranges: two bytes, or a name."""
    return s[at].astype(np.int32) << 8 | s[at + 1] if s.dtype == np.uint8 else s[at]


def _sums(s: np.ndarray, places: np.ndarray, symbols: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda s, at: s[at]) -> np.ndarray:
    """How many of the places (or of all where a mask holds) have each symbol or a smaller one; a 0 comes first."""
    out = scratch(symbols + 1, np.int64)
    for a, b in _blocks(len(places)):
        symbol = s[a:b][places[a:b]] if places.dtype == bool else of(s, places[a:b])
        np.add.at(out, symbol.astype(np.int64) + 1, 1)
    return np.cumsum(out, out=out)


def _key(s: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first symbols at places as one number: eight of bytes, two of names; where fewer are left, ones follow."""
    if s.dtype == np.uint8:
        words = np.ndarray(len(s) - 7, ">u8", s, strides=(1,))
        short = np.clip(left, 0, 8).astype(np.uint64)
        key = words[np.minimum(at, len(s) - 8)].astype(np.uint64)
        ones = np.where(short >= 8, np.uint64(0), np.uint64(2**64 - 1) >> (np.uint64(8) * np.minimum(short, np.uint64(7))))
        return key | ones
    first, second = (np.where(x < len(s), s[np.minimum(x, len(s) - 1)] + 1, 0).astype(np.uint64) for x in (at, at + 1))
    second[left < 2] = 0xFFFFFFFF
    key = first << np.uint64(32) | second  # 0 stands behind the end
    key[left < 1] = 2**64 - 1
    return key


def _sorted_range(s: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of these sizes at places, and which of them differ from the one before."""
    per = 8 if s.dtype == np.uint8 else 2
    key = _key(s, at, size)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for offset in range(per, depth, per):
        first = np.flatnonzero(new)
        longest = np.maximum.reduceat(size[order], first)
        many = (np.diff(np.append(first, len(at))) > 1) & (longest > offset)
        if not many.any():
            break
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero(many[group])
        mine, group = order[open_], group[open_]
        key = _key(s, at[mine] + offset, size[mine] - offset)
        inner = np.lexsort((key, group))
        order[open_] = mine[inner]
        key = key[inner]
        new[open_[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    return order, new


def sorted_seeds(s: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The seeds in the order of their suffixes. A string of bytes must go on for eight bytes after its last symbol."""
    m, symbols = len(at), 1 << 16 if s.dtype == np.uint8 else int(s.max()) + 1
    sums = _sums(s, at, symbols, _first)
    ranges = _ranges(sums, symbols)
    place = scratch(m, np.int32)  # the seeds dealt to their ranges
    ends = np.array([0, *(sums[high] for _, high in ranges)])
    which = np.repeat(np.arange(len(ranges), dtype=np.int32), [high - low for low, high in ranges])
    filled = ends[:-1].copy()
    for a, b in _blocks(m):
        own = which[_first(s, at[a:b])]
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(ranges))
        target = np.repeat(filled - (np.cumsum(count) - count), count) + np.arange(b - a)
        place[target] = a + order
        filled += count
    names, named = scratch(m, np.int32), 0
    for a, b in zip(ends[:-1], ends[1:]):
        mine = place[a:b]
        here = at[mine].astype(np.int64)
        after = at[np.minimum(mine + 1, m - 1)]
        size = np.minimum(np.where(mine + 1 < m, after - here + 1, len(s) + 1 - here), depth)
        order, new = _sorted_range(s, here, size, depth)
        place[a:b] = mine[order]
        names[place[a:b]] = named + np.cumsum(new) - 1
        named += int(new.sum())
    if named < m and depth > 2:
        place = ascending(names, -(-depth // 2), named)
    return _each(place, np.int32, lambda x: at[x])


def _ranges(sums: np.ndarray, symbols: int) -> list[tuple[int, int]]:
    """Ranges of symbols that have about a batch of items each."""
    out, low = [], 0
    while low < symbols:
        high = min(symbols, max(low + 1, int(np.searchsorted(sums, sums[low] + BATCH, side="right")) - 1))
        out.append((low, high))
        low = high
    return out


def ascending(s: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """All suffixes of a string of names in ascending order; behind its end stands the least symbol."""
    small = types(s, False)
    at = leftmost(small)
    seeds = sorted_seeds(s, at, depth) if len(at) else at
    large = _induced(s, _each(small, bool, np.logical_not), seeds, len(s) - 1, symbols, False)
    down = _induced(_each(s, np.int32, lambda x: symbols - 1 - x), small, large[::-1], None, symbols, True)
    return down[::-1]


def _induced(s: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, first: int | None, symbols: int, every: bool) -> np.ndarray:
    """The wanted suffixes (or all) in the order that the sorted seeds induce, range by range of the symbols.

    Within a range, suffixes come from the queue, from others of the range, and last, under each symbol, from the seeds."""
    stop, many = _sums(s, seeds, symbols), _sums(s, wanted, symbols)
    n_wanted = int(many[-1])
    many += stop
    out, done = scratch(int(many[-1]) if every else n_wanted, np.int32), 0
    queue = DiskQueue()
    if first is not None:
        queue.push(s[first : first + 1], np.array([first], np.int32))
    for low, high in _ranges(many, symbols):
        _, got = queue.take(low, high)
        came = np.concatenate([p for _, p in got]) if got else np.zeros(0, np.int32)
        place = np.concatenate([came, seeds[stop[low] : stop[high]]])
        kind = np.repeat(np.array([0, 2], np.int64), [len(came), len(place) - len(came)])
        under = np.arange(len(place))
        symbol = s[place].astype(np.int64) - low
        order = np.argsort(symbol << 34 | kind << 32 | under)
        fresh = np.arange(len(place))
        parent = np.full(len(place), -1)
        while len(fresh):  # what the newest induce within the range is merged in; the order of all others stands
            left = place[fresh] - 1
            ok = (left >= 0) & wanted[left]
            ok[ok] = s[left[ok]] < high
            born = left[ok]
            if not len(born):
                break
            rank = np.empty(len(place), np.int64)
            rank[order] = np.arange(len(place))
            n = len(place)
            place, parent = np.concatenate([place, born]), np.concatenate([parent, fresh[ok]])
            kind, symbol = np.concatenate([kind, np.ones(len(born), np.int64)]), np.concatenate([symbol, s[born] - low])
            under = np.concatenate([under, np.zeros(len(born), np.int64)])
            child = kind == 1
            under[child] = rank[parent[child]]
            key = symbol << 34 | kind << 32 | under
            fresh = np.arange(n, len(place))
            sorted_fresh = fresh[np.argsort(key[n:])]
            old = key[order]
            order = np.insert(order, np.searchsorted(old, key[sorted_fresh]), sorted_fresh)
        scanned = place[order]
        mine = scanned if every else scanned[kind[order] < 2]
        out[done : done + len(mine)] = mine
        done += len(mine)
        left = scanned - 1
        ok = (left >= 0) & wanted[left]
        ok[ok] = s[left[ok]] >= high
        left = left[ok]
        if len(left):
            symbol = s[left]
            order = np.argsort(symbol, kind="stable")
            queue.push(symbol[order], left[order])
    queue.close()
    return out


class _Scan:
    """Pushes the left neighbours of one kind of scanned suffixes, with what they share."""

    def __init__(self, s: np.ndarray, wanted: np.ndarray, queue: DiskQueue, symbols: int):
        self.s, self.wanted, self.queue = s, wanted, queue
        self.low = np.full(symbols, 254, np.uint8)  # least value scanned since the last push under a symbol
        self.any = np.zeros(symbols, bool)

    def feed(self, position: np.ndarray, shared: np.ndarray) -> None:
        """position: suffixes in scanned order; shared: what each shares with the one scanned before it."""
        for a, b in _blocks(len(position)):
            self._feed(np.asarray(position[a:b]), np.asarray(shared[a:b]))

    def _feed(self, position: np.ndarray, shared: np.ndarray) -> None:
        left = position - 1
        k = np.flatnonzero(self.wanted[left] & (position > 0))
        if not len(k):
            self.low = np.minimum(self.low, shared.min())
            return
        symbol = self.s[left[k]]
        order = np.argsort(symbol, kind="stable")
        k, symbol = k[order], symbol[order]
        ends = np.minimum.accumulate(shared)
        starts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        firsts = np.concatenate([_ZERO, starts])
        lasts = np.concatenate([starts - 1, np.array([len(k) - 1])])
        value = np.empty(len(k), np.uint8)
        if len(k) > len(firsts):
            value[1:] = _least(shared, k[:-1] + 1, k[1:])
        met = symbol[firsts]
        value[firsts] = np.minimum(self.low[met], ends[k[firsts]])
        value = np.minimum(value, 253) + np.uint8(1)
        value[firsts[~self.any[met]]] = 0
        self.queue.push(symbol, left[k].astype(np.int32), value)
        self.low = np.minimum(self.low, ends[-1])
        tail = np.full(len(shared) + 1, 254, np.uint8)
        tail[:-1] = np.minimum.accumulate(shared[::-1])[::-1]
        self.low[met] = tail[k[lasts] + 1]
        self.any[met] = True


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b] for each pair, from a table of powers of two; anything where a > b."""
    gap = b - a
    out = values[np.minimum(a, b)]
    level = np.frexp(np.maximum(gap, 0) + 1)[1] - 1
    table, span = values, 1
    for j in range(1, int(level.max()) + 1):
        table = np.minimum(table[:-span], table[span:])
        span *= 2
        here = np.flatnonzero(level == j)
        out[here] = np.minimum(table[a[here]], table[b[here] - span + 1])
    return out


def common(s: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols the suffixes at a and b share, depth at most; s goes on for eight bytes after the last of them."""
    out = np.full(len(a), depth, np.uint8)
    words = np.ndarray(len(s) - 7, ">u8", s, strides=(1,))
    left, last = np.arange(len(a)), len(s) - 8
    for offset in range(0, depth, 8):
        x = words[np.minimum(a[left] + offset, last)].astype(np.uint64) ^ words[np.minimum(b[left] + offset, last)].astype(np.uint64)
        here = np.flatnonzero(x)
        zeros = np.zeros(len(here), np.int64)
        for byte in range(1, 8):
            zeros += x[here] < np.uint64(1) << np.uint64(64 - 8 * byte)
        out[left[here]] = np.minimum(depth, offset + zeros)
        left = left[x == 0]
    return out


def descending(padded: np.ndarray, n: int, depth: int, memory: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes but the last of the first n symbols in descending order, and what each shares with the one before it.

    padded: uint8 symbols below 255, of which 0 ends strings and is the last of the n; at least eight zeros follow, which
    may be read but aren't sorted. depth is below 250."""
    s = padded[:n]
    symbols = int(s.max()) + 1
    small = types(s, True)
    seeds = sorted_seeds(padded, leftmost(small), depth)
    shared_seeds = scratch(len(seeds), np.uint8)
    for a, b in _blocks(len(seeds)):
        here = seeds[max(0, a - 1) : b].astype(np.int64)
        shared_seeds[b - len(here) + 1 : b] = common(padded, here[:-1], here[1:], depth)
    bounds = _sums(s, seeds, symbols).tolist()
    n_large = int(n - small.sum())
    large, shared_large = scratch(n_large, np.int32), scratch(n_large, np.uint8)
    ends = np.zeros(symbols + 1, np.int64)

    def pair(x: int, y: int) -> np.ndarray:
        return common(padded, np.array([x]), np.array([y]), depth)[0]

    wanted, done = _each(small, bool, np.logical_not), 0
    queue = DiskQueue(memory)
    scan = _Scan(s, wanted, queue, symbols)
    for c in range(symbols):
        seen, got = queue.take(c, c + 1)
        while got:
            for _, position, shared in got:
                large[done : done + len(position)], shared_large[done : done + len(position)] = position, shared
                done += len(position)
                scan.feed(position, shared)
            seen, got = queue.take(c, c + 1, seen)
        ends[c + 1] = done
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            shared_seeds[a] = pair(int(large[done - 1]), int(seeds[a])) if done > ends[c] else 0
            scan.feed(seeds[a:b], shared_seeds[a:b])
    queue.close()

    out, values, done = scratch(n - 1, np.int32), scratch(n - 1, np.uint8), 0
    queue = DiskQueue(memory)
    scan = _Scan(s, small, queue, symbols)
    flipped = _Flipped(queue, symbols)
    scan.queue = flipped
    for c in range(symbols - 1, -1, -1):
        begin = done
        seen, got = flipped.take(c, 0)
        while got:
            for _, position, shared in got:
                out[done : done + len(position)], values[done : done + len(position)] = position, shared
                done += len(position)
                scan.feed(position, shared)
            seen, got = flipped.take(c, seen)
        a, b = int(ends[c]), int(ends[c + 1])
        if b > a:
            position = large[a:b][::-1]
            down = scratch(b - a, np.uint8)
            down[0] = pair(int(out[done - 1]), int(large[b - 1])) if done > begin else 0
            down[1:] = shared_large[a + 1 : b][::-1]
            out[done : done + b - a], values[done : done + b - a] = position, down
            done += b - a
            scan.feed(position, down)
    queue.close()
    return out, values


class _Flipped:
    """A queue that gives the largest symbols first."""

    def __init__(self, queue: DiskQueue, symbols: int):
        self.queue, self.top = queue, symbols - 1

    def push(self, symbol: np.ndarray, position: np.ndarray, shared: np.ndarray) -> None:
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        size = np.diff(np.append(starts, len(symbol)))[::-1]
        at = np.repeat(starts[::-1] - (np.cumsum(size) - size), size) + np.arange(len(symbol))
        self.queue.push(np.uint8(self.top) - symbol[at], position[at], shared[at])

    def take(self, symbol: int, seen: int) -> tuple[int, list]:
        return self.queue.take(self.top - symbol, self.top - symbol + 1, seen)


def classes(strings: np.ndarray, lengths: np.ndarray, n: int, memory: int | None = None) -> np.ndarray:
    """For the n-byte strings that start in strings laid out one after another: numbers, equal for equal ones."""
    total = int(len(strings) + len(lengths))
    padded = scratch(total + 16, np.uint8)
    seen = np.zeros(256, bool)
    for a, b in _blocks(len(strings)):
        seen[strings[a:b]] = True
    code = np.cumsum(seen)
    if code[-1] > 253:
        raise ValueError("text isn't UTF-8")
    code = code.astype(np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    gap = np.arange(len(lengths))
    for a, b in _blocks(len(strings)):  # symbol i lies behind as many ends as strings end before it
        place = np.arange(a, b)
        padded[place + np.searchsorted(begin - gap + lengths, place, side="right")] = code[strings[a:b]]
    position, shared = descending(padded, total, n, memory)
    number, last = scratch(total, np.int32), 0
    for a, b in _blocks(total - 1):
        own = last + np.cumsum(shared[a:b] < n)
        number[position[a:b]] = own
        last = int(own[-1])
    size = np.maximum(0, lengths - n + 1)
    out, done = scratch(int(size.sum()), np.int32), 0
    for a, b in _blocks(len(lengths)):
        own = size[a:b]
        inner = np.arange(int(own.sum())) + np.repeat(begin[a:b] - (np.cumsum(own) - own), own)
        out[done : done + len(inner)] = number[inner]
        done += len(inner)
    return out
