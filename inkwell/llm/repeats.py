"""Windows of n symbols that stand more than once in a corpus, found without moving a row for each of them.

Symbols are bytes or words. A window is named by the least hash of the k-symbol strings in it; windows in a row with one name,
n at most, form a run, and equal windows have equal names. Texts lie in crates of some megabytes, and crates ask about names
and strings by buckets of hash ranges, a sorted list per crate and bucket:

1. Which names stand in several crates, in several runs of one, or in one run again and again? All windows with other names are unique, and nothing more
   is asked about them. Names are counted, too. One whose strings may outgrow GROUP_SYMBOLS is too heavy for a group: its
   runs are named anew by longer prefixes, the shared k symbols with those that follow (or, at the end of a window,
   precede) them, up to halfway to n, and the question is put again; names too heavy still are replaced by whole windows.
2. What do the strings of the runs that are left repeat? Now strings themselves are sent, bytes or words, not hashes; a
   crate sends each once, and equal ones of several crates are merged, both by comparing them whole. A shard of byte strings
   is sorted by external induction, and neighbours that share n symbols are equal windows; a shard of words is split by
   names into groups that fit in memory, of whose suffixes a tree is built, and its deep internal nodes are the repeats.

Hashes so only choose what is compared; that windows are equal is found by the sorter or the trees.

With by_id, a window counts if it stands in a document with a smaller id (null ids come last); without, if it stands
anywhere else, the same document included. A list holds each name once, however many copies a crate has of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _BYTE, IS_SPACE, _powers, cut, flat, mix64, placed, span_hashes, spread, words
from inkwell.llm.induced import classes
from inkwell.llm.suffix_tree import build, maximal_repeats

LAST = np.iinfo(np.int64).max
#: Symbols hashed at a time; text bytes in a crate (a longer text is a crate of its own), for a bucket of names, and for a shard.
BLOCK, CRATE_BYTES, BUCKET_BYTES, SHARD_BYTES = 1 << 15, 1 << 22, 1 << 22, 1 << 23
#: Words in the strings of one name, at most, and of one tree; four times as many bytes, which are sorted in files.
GROUP_SYMBOLS = 1 << 20
NONE, WANTED, HEAVY = 0, 1, 2
#: Levels of prefixes, from k symbols to n. Questions 0 to 2 are about the names of a level, the last about strings.
LEVELS = STRINGS = 3


@dataclass(frozen=True)
class Shape:
    n: int
    k: int
    by_words: bool
    by_id: bool

    @property
    def limit(self) -> int:
        return GROUP_SYMBOLS if self.by_words else 4 * GROUP_SYMBOLS


class Crate:
    """Some texts as symbols, and the runs of their windows: places of first windows, sizes, names and ids of documents."""

    def __init__(self, shape: Shape, batch: pa.RecordBatch):
        self.shape = shape
        self.ids = pc.fill_null(batch["doc_id"], LAST).to_numpy(zero_copy_only=False)
        data, offsets = flat(pc.fill_null(batch["text"], ""))
        if shape.by_words:
            starts, ends, self.offsets = words(data, offsets)
            self.sym = span_hashes(data, starts, ends)
            self.at = np.r_[0, np.cumsum(ends - starts + 1)]
            inside = np.ones(self.at[-1], bool)
            inside[self.at[1:] - 1] = False
            joined = np.full(self.at[-1], 0x20, np.uint8)  # words, each with one space behind it
            joined[inside] = data[~IS_SPACE[data]]
            self.raw, self.size = joined.tobytes(), len(starts)
        else:
            self.raw, self.offsets, self.data, self.size = data.tobytes(), offsets, data, len(data)
        self.runs = self._runs()

    def symbols(self, a: int, b: int) -> np.ndarray:
        return self.sym[a:b] if self.shape.by_words else _BYTE[self.data[a:b]]

    def _runs(self) -> tuple[np.ndarray, ...]:
        n, k = self.shape.n, self.shape.k
        up, down = _powers(BLOCK + n + 1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        periodic = [np.zeros(0, np.uint64)]
        for s in range(0, self.size - n + 1, BLOCK):
            e = min(s + BLOCK, self.size - n + 1)
            part = self.symbols(s, e + n - 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            grams, width = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1], n - k + 1
            v = _sliding(np.minimum, grams, width)
            if not self.shape.by_id:
                periodic.append(_recurring(grams, v, width, n))
            edges = self.offsets[np.searchsorted(self.offsets, s, "right") : np.searchsorted(self.offsets, e + n - 1)]
            over = _covered(e - s, np.maximum(0, edges - n + 1 - s), np.maximum(0, np.minimum(edges - s, e - s)))
            new = np.ones(e - s, bool)
            new[1:] = (v[1:] != v[:-1]) | (over[1:] != over[:-1])
            at = np.flatnonzero(new)
            run, place = spread(-(-np.diff(np.append(at, e - s)) // n))  # n windows at most
            at = at[run] + place * n
            size = np.diff(np.append(at, e - s))
            good = ~over[at]
            found.append((at[good] + s, size[good], v[at[good]]))
        start, size, name = (np.concatenate(x) for x in zip(*found))
        self.periodic = np.unique(mix64(np.concatenate(periodic)))
        return start, size, mix64(name), self._ids(start)  # least hashes crowd near 0: mixed, names spread evenly

    def _ids(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, places, side="right") - 1] if len(self.ids) else np.zeros(0, np.int64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of symbols in order of their starts."""
        out, k = np.zeros(len(starts), np.uint64), 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(starts, starts[k] + BLOCK)))
            a, b = int(starts[k]), int(ends[k:last].max())
            up, down = _powers(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.symbols(a, b) * up[: b - a], out=sums[1:])
            out[k:last] = mix64((sums[ends[k:last] - a] - sums[starts[k:last] - a]) * down[starts[k:last] - a] + (ends - starts)[k:last].astype(np.uint64))
            k = last
        return out

    def names(self, runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The names of runs in order, how many different strings each has, and whether the crate alone may hold repeats."""
        start, size, name, ids = runs
        order = np.argsort(name, kind="stable")
        sorted_names = name[order]
        first = np.flatnonzero(np.r_[True, sorted_names[1:] != sorted_names[:-1]][: len(order)])
        count = np.diff(np.append(first, len(order)))
        inside = (count > 1) | np.isin(sorted_names[first], self.periodic)
        if self.shape.by_id and len(first):
            inside = np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(ids[order], first)
        group = np.repeat(np.arange(len(first)), count)
        some = np.flatnonzero((count > 1)[group])
        spans = order[some]
        by_place = np.argsort(start[spans], kind="stable")
        hashed = np.empty(len(spans), np.uint64)
        hashed[by_place] = self.hashes(start[spans][by_place], (start + size)[spans][by_place] + self.shape.n - 1)
        by_string = np.lexsort((hashed, group[some]))
        g, h = group[some][by_string], hashed[by_string]
        differs = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])][: len(g)]
        weight = np.bincount(g, differs, len(first))
        weight[count == 1] = 1
        return sorted_names[first], np.minimum(weight, 2**31).astype(np.uint32), inside

    def refined(self, runs: tuple[np.ndarray, ...], level: int) -> tuple[np.ndarray, ...]:
        """Runs of one level cut into those of the next, which are named by longer prefixes."""
        (start, size, name, ids), (n, k) = runs, (self.shape.n, self.shape.k)
        run, place = spread(size)
        p = start[run] + place
        if level + 2 == LEVELS:
            order = np.argsort(p, kind="stable")
            names = np.empty(len(p), np.uint64)
            names[order] = self.hashes(p[order], p[order] + n)
            return p, np.ones(len(p), np.int64), names, ids[run]
        m = (n + k + 1) // 2
        owner, place = spread(size + n - k)
        q = start[owner] + place
        gram = np.zeros(len(q), np.uint64)
        up = _powers(k)[0]
        low = int(q.min(initial=0))
        near = self.symbols(low, int(q.max(initial=0)) + k)
        for j in range(k):
            gram += near[q + j - low] * up[j]
        here = mix64(gram) == name[owner]
        far = self.size + 1
        g = q[here][np.searchsorted(owner[here] * far + q[here], run * far + p)]  # the first place of the name in each window
        a = np.where(g + m <= p + n, g, g + k - m)
        new = np.flatnonzero(np.r_[True, (np.diff(run) != 0) | (np.diff(a) != 0)][: len(a)])
        order = np.argsort(a[new], kind="stable")
        names = np.empty(len(new), np.uint64)
        names[order] = self.hashes(a[new][order], a[new][order] + m)
        return p[new], np.diff(np.append(new, len(p))), names, ids[run[new]]

    def levels(self, told: dict[int, dict[int, bytes]]) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, tuple]]:
        """Level by level the runs, what is said of each, and their names; ends with the first level that isn't answered."""
        runs = self.runs
        for level in range(LEVELS):
            names, weight, inside = self.names(runs)
            said = np.zeros(len(names), np.uint8)
            buckets = told.get(-1, {}).get(0, 0)
            for bucket, (a, b) in stretches(dealt(names, buckets)).items():
                if bucket in told.get(level, {}):
                    said[a:b] = np.frombuffer(told[level][bucket], np.uint8)
            verdict = said[np.searchsorted(names, runs[2])] if len(names) else said
            yield runs, verdict, (names, weight, inside)
            heavy = verdict == HEAVY
            if not heavy.any():
                return
            runs = self.refined(tuple(x[heavy] for x in runs), level)

    def strings(self, told: dict[int, dict[int, bytes]], shards: int) -> tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """The different strings of all runs that are wanted, in order of their shards, and these; the runs, and which
        string each has."""
        parts = [tuple(x[verdict == WANTED] for x in runs) for runs, verdict, _ in self.levels(told)]
        start, size, name, ids = runs = tuple(np.concatenate(x) for x in zip(*parts))
        a, b = start, start + size + self.shape.n - 1
        if self.shape.by_words:
            a, b = self.at[a], self.at[b] - 1
        raw, known = self.raw, {}
        entry = np.array([known.setdefault(raw[i:j], len(known)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
        first = np.unique(entry, return_index=True)[1]
        shard = dealt(name[first], shards)
        order = np.argsort(shard, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        strings = list(known)
        return [strings[i] for i in order.tolist()], shard[order], runs, back[entry]

    def asks(self, question: int, told: dict[int, dict[int, bytes]], buckets: int) -> Iterator[tuple[int, list[bytes]]]:
        """Bucket, and names, their counts and flags, or else strings, their sizes, their least ids or counts, and names."""
        if question < STRINGS:
            levels = list(self.levels(told))
            if len(levels) > question:
                columns = levels[question][2]
                for bucket, (a, b) in stretches(dealt(columns[0], buckets)).items():
                    yield bucket, [*(x[a:b].tobytes() for x in columns), b""]
            return
        strings, shard, (_, _, name, ids), entry = self.strings(told, buckets)
        if self.shape.by_id:
            most = least(entry, ids, len(strings))
        else:
            most = np.minimum(2, np.bincount(entry, minlength=len(strings)))
        names = np.zeros(len(strings), np.uint64)
        names[entry] = name
        size = np.array([len(x) for x in strings], np.uint32)
        for bucket, (a, b) in stretches(shard).items():
            yield bucket, [b"".join(strings[a:b]), size[a:b].tobytes(), most[a:b].tobytes(), names[a:b].tobytes()]

    def repeated(self, told: dict[int, dict[int, bytes]], shards: int) -> np.ndarray:
        """Which symbols lie in windows that count."""
        strings, shard, (start, _, _, ids), entry = self.strings(told, shards)
        count, size, value = np.zeros(len(strings), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for bucket, (a, b) in stretches(shard).items():
            if bucket in told.get(STRINGS, {}):
                part = Stretches.read(told[STRINGS][bucket], b - a)
                count[a:b] = part.count
                size.append(part.size)
                value.append(part.value)
        size, value = np.concatenate(size), np.concatenate(value)
        before = np.r_[0, np.cumsum(size)]
        own = np.cumsum(count) - count
        run, place = spread(count[entry])
        at = own[entry[run]] + place
        hit = value[at] < ids[run] if self.shape.by_id else value[at] > 0
        run, at = run[hit], at[hit]
        begin = start[run] + before[at] - before[own[entry[run]]]
        return _covered(self.size, begin, begin + size[at] + self.shape.n - 1)


@dataclass
class Stretches:
    """For strings laid out one after another the values of their windows, as stretches of equal ones: how many each string
    has, their sizes and values."""

    count: np.ndarray
    size: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, windows: np.ndarray) -> Stretches:
        new = np.zeros(len(values) + 1, bool)
        new[:-1] = np.r_[True, values[1:] != values[:-1]][: len(values)]
        new[np.cumsum(windows) - windows] = True
        at = np.flatnonzero(new[:-1])
        string = np.repeat(np.arange(len(windows)), windows)[at]
        return cls(np.bincount(string, minlength=len(windows)), np.diff(np.append(at, len(values))), values[at])

    def take(self, strings: np.ndarray) -> Stretches:
        begin = np.cumsum(self.count) - self.count
        own, place = spread(self.count[strings])
        at = begin[strings][own] + place
        return Stretches(self.count[strings], self.size[at], self.value[at])

    def write(self) -> bytes:
        return b"".join([self.count.astype(np.uint16).tobytes(), self.size.astype(np.uint16).tobytes(), self.value.astype(np.int64).tobytes()])

    @classmethod
    def read(cls, raw: bytes, n: int) -> Stretches:
        count = np.frombuffer(raw, np.uint16, n).astype(np.int64)
        total = int(count.sum())
        return cls(count, np.frombuffer(raw, np.uint16, total, 2 * n).astype(np.int64), np.frombuffer(raw[2 * (n + total) :], np.int64))


def _sliding(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over every stretch of width values."""
    span, n = 1, len(x) - width + 1
    while span * 2 <= width:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[:n], x[width - span : width - span + n])


def _recurring(grams: np.ndarray, v: np.ndarray, width: int, n: int) -> np.ndarray:
    """Least hashes of windows that come again within n symbols: then windows of one run may be equal, too."""
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([none, v, none]), width))
    at = at[np.argsort(grams[at], kind="stable")]
    again = (grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= n)
    return np.unique(grams[at[1:]][again])


def dealt(names: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range of each name, of so many."""
    return ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stretches(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each bucket begins and ends in a sorted list."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    return {int(bucket[a]): (int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(bucket)))}


def least(group: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST, np.int64)
    np.minimum.at(out, group, ids)
    return out


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of size places lie in one of the spans."""
    step = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(step)[:-1] > 0


def answered(question: int, shape: Shape) -> Callable[[pa.Table], pa.Table]:
    """A function that answers all crates that ask about one bucket."""

    def reply(asked: pa.Table) -> pa.Table:
        cells = repeats_of(asked, shape) if question == STRINGS else verdicts(asked, question, shape)
        heavy = pa.array([question < STRINGS and bytes([HEAVY]) in x for x in cells], pa.bool_())
        return pa.table({"crate": asked["crate"], "question": pa.array([question] * len(cells), pa.int32()), "bucket": asked["bucket"], "said": pa.array(cells, pa.binary()), "heavy": heavy})

    return reply


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def verdicts(asked: pa.Table, question: int, shape: Shape) -> list[bytes]:
    """For each crate which of its names stand elsewhere, too, and which of these are too heavy."""
    names, weight, inside = (_joined(asked[c], kind) for c, kind in (("first", np.uint64), ("second", np.uint32), ("third", bool)))
    size = pc.binary_length(asked["first"]).to_numpy() // 8
    _, back, count = np.unique(names, return_inverse=True, return_counts=True)
    wanted = (count > 1) | (np.bincount(back, inside, len(count)) > 0)
    heavy = wanted & (np.bincount(back, weight, len(count)) * (2 * shape.n - 1) > shape.limit) & (question + 1 < LEVELS)
    out = np.where(heavy, HEAVY, wanted * WANTED).astype(np.uint8)[back]
    return [x.tobytes() for x in np.split(out, np.cumsum(size)[:-1])]


def repeats_of(asked: pa.Table, shape: Shape) -> list[bytes]:
    """For each crate the least ids of the windows of its strings, or whether these stand elsewhere, too, as Stretches."""
    known: dict[bytes, int] = {}
    entry: list[int] = []
    for text, sizes in zip(asked["first"].to_pylist(), asked["second"].to_pylist()):
        ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
        entry += [known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends], ends)]
    most, names = _joined(asked["third"], np.int64), _joined(asked["fourth"], np.uint64)
    entry, strings = np.array(entry, np.int64), list(known)
    first = np.unique(entry, return_index=True)[1]
    own = least(entry, most, len(strings)) if shape.by_id else np.bincount(entry, most, len(strings)).astype(np.int64)
    found = _trees(strings, names[first], own, shape) if shape.by_words else _induced(strings, own, shape)
    per = pc.binary_length(asked["second"]).to_numpy() // 4
    return [found.take(x).write() for x in np.split(entry, np.cumsum(per)[:-1])]


def _induced(strings: list[bytes], own: np.ndarray, shape: Shape) -> Stretches:
    """own: of each string the least id, or how often it stands."""
    lengths = np.array([len(x) for x in strings], np.int64)
    windows = lengths - shape.n + 1
    number = classes(np.frombuffer(b"".join(strings), np.uint8), lengths, shape.n)
    each = np.repeat(own, windows)
    top = int(number.max()) + 1
    if shape.by_id:
        return Stretches.of(least(number, each, top)[number], windows)
    return Stretches.of((np.bincount(number, each, top) > 1)[number].astype(np.int64), windows)


def _trees(strings: list[bytes], names: np.ndarray, own: np.ndarray, shape: Shape) -> Stretches:
    """As _induced, for strings of words, which are split by names into groups for a tree each."""
    order = np.argsort(names, kind="stable")
    lengths = np.array([x.count(b" ") + 1 for x in strings], np.int64)
    new = np.flatnonzero(np.r_[True, np.diff(names[order]) != 0])
    sums = np.append(np.r_[0, np.cumsum(lengths[order])][new], lengths.sum())
    counts, sizes, values, k = [], [], [], 0
    while k < len(new):  # names are added while their strings fit
        last = max(k + 1, int(np.searchsorted(sums, sums[k] + GROUP_SYMBOLS, side="right")) - 1)
        mine = order[new[k] : new[last] if last < len(new) else len(order)]
        part = _tree([strings[i] for i in mine.tolist()], lengths[mine], own[mine], shape)
        counts.append(part.count)
        sizes.append(part.size)
        values.append(part.value)
        k = last
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Stretches(*(np.concatenate(x) for x in (counts, sizes, values))).take(back)


def _tree(strings: list[bytes], lengths: np.ndarray, own: np.ndarray, shape: Shape) -> Stretches:
    windows = lengths - shape.n + 1
    group, place = spread(windows)
    code: dict[bytes, int] = {}
    symbols = np.array([code.setdefault(w, len(code)) for w in b" ".join(strings).split(b" ")], np.int64)
    at = (np.cumsum(lengths) - lengths)[group] + place
    if shape.by_id:
        tree = build(symbols, lengths, shape.n)
        node = np.empty(len(symbols), np.int64)
        node[tree.leaf] = tree.nodes(shape.n)
        return Stretches.of(least(node[at], own[group], len(tree.leaf))[node[at]], windows)
    more = np.flatnonzero(own > 1)  # strings that stand more than once are hung in twice
    again = symbols[np.repeat((np.cumsum(lengths) - lengths)[more], lengths[more]) + spread(lengths[more])[1]]
    tree = build(np.concatenate([symbols, again]), np.concatenate([lengths, lengths[more]]), shape.n)
    start, length = maximal_repeats(tree, len(symbols) + len(again), shape.n)
    hit = _covered(len(symbols) + len(again), start, start + length - shape.n + 1)
    return Stretches.of(hit[at].astype(np.int64), windows)


def packed(docs: DataFrame) -> DataFrame:
    """docs in crates (crate, size, texts): some rows with all their columns, as one Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + CRATE_BYTES, side="right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(start, stop - start))
                yield pa.RecordBatch.from_pydict({"crate": pa.array([number], pa.int64()), "size": pa.array([int(ends[stop - 1]) - before], pa.int64()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                number, start = number + 1, stop

    return docs.mapInArrow(run, "crate long, size long, texts binary")


def unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def with_repeats(docs: DataFrame, shape: Shape, make: Callable[[pa.RecordBatch, Crate, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What make makes of each batch of docs, its Crate, and the mask of its symbols in windows that count."""
    crates = placed(packed(docs), "crate")
    size = crates.agg(F.sum("size")).first()[0] or 0
    buckets, shards = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // SHARD_BYTES))
    answers: DataFrame | None = None
    heavy = True
    for question in range(STRINGS + 1):
        if not heavy and question < STRINGS:
            continue
        many = shards if question == STRINGS else buckets

        def ask(batches: Iterator[pa.RecordBatch], question: int = question, many: int = many) -> Iterator[pa.RecordBatch]:
            for crate, texts, told in _rows(batches, buckets):
                rows = list(Crate(shape, unpacked(texts)).asks(question, told, many))
                columns = [pa.array([crate] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int64()), *(pa.array([x[i] for _, x in rows], pa.binary()) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["crate", "bucket", "first", "second", "third", "fourth"])

        asked = _told(crates, answers).mapInArrow(ask, "crate long, bucket long, first binary, second binary, third binary, fourth binary")
        new = cut(asked.groupBy("bucket").applyInArrow(answered(question, shape), "crate long, question int, bucket long, said binary, heavy boolean"))
        heavy = question < STRINGS and not new.where("heavy").isEmpty()
        answers = new if answers is None else answers.unionAll(new)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, told in _rows(batches, buckets):
            batch = unpacked(texts)
            crate = Crate(shape, batch)
            yield make(batch, crate, crate.repeated(told, shards))

    return _told(crates, answers).mapInArrow(finish, schema)


def _told(crates: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is None:
        return crates.select("crate", "texts", F.lit(None).cast("array<struct<question:int,bucket:long,said:binary>>").alias("told"))
    own = answers.groupBy("crate").agg(F.collect_list(F.struct("question", "bucket", "said")).alias("told"))
    return crates.select("crate", "texts").join(own, "crate", "left")


def _rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, bytes, dict[int, dict[int, bytes]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            told: dict = {-1: {0: buckets}}
            for x in batch["told"][i].as_py() or []:
                told.setdefault(x["question"], {})[x["bucket"]] = x["said"]
            yield batch["crate"][i].as_py(), batch["texts"][i].as_py(), told
