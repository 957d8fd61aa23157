"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct lower-cased words, these without the signs around them, and their beginnings, each
hashed to one of 2**BITS places. A place has a linear weight and a vector, and each pair of places adds the product of their
vectors, so that an insult beside a mention of a group can weigh more than the sum of both. A place also has a scale, by which
it enters a text: either 1, or less the more alike its frequency in both classes is, which learns better from few rows but
is blind to terms that only mean something in pairs. The machine is fitted both ways on four fifths of the first TRIED rows of
each class, and then on all of them in the way that loses less on the other fifth.

The driver fits it, on labelled rows outside the held-out third: of each class those whose hashed ids are smallest, at most
MAX_TOXIC or MAX_CLEAN and at most MAX_TERMS terms together, whatever the length of each. The text alone is scored.

A null or empty text has no term and gets the score of the bias. Both classes weigh the same in the fit. Null labels, and those
of a null id, teach nothing; of several labels of one id the highest counts, and of several texts of one id the least is
learned from. Repeated rows are scored alike, each of them; a null id isn't held out; an empty table gives an empty one. Without
labels of both classes every score is the smoothed share of toxic labels. Columns but doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, cut, slices, table

FIND = regex.compile(WORD).findall
AROUND = regex.compile(r"^\P{L}+|\P{L}+$")
#: At most so many labelled rows of each class are sampled, and of each class at most so many terms.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS = 2000, 4000, 1 << 23
#: Terms are hashed to 2**BITS places; those met in fewer sampled texts than LEAST_TEXTS weigh nothing.
BITS, LEAST_TEXTS = 18, 2
RANK, EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 4, 8, 300, 128, 0.1, 1e-4, 20
#: Small samples are gone through for STEPS batches or WORK terms, whichever is less. Rows of each class to choose scales by.
WORK, TRIED = 1 << 24, 1000
THRESHOLD = 0.7
#: Distinct words that a worker remembers before it starts anew.
MEMORY = 400_000
PREFIXES = (4, 5)
WIDTH = 2 + len(PREFIXES)


def terms(word: str) -> list[int]:
    """Places of the terms of a lower-cased word, from 1 on; 0 is the bias."""
    bare = AROUND.sub("", word)
    found = [word, *([f"{bare}~"] if bare != word else []), *(f"{bare[:n]}*{n}" for n in PREFIXES if len(bare) >= n)]
    return [(xxhash.xxh3_64_intdigest(x) >> (64 - BITS)) + 1 for x in found]


def distinct_terms(text: str) -> np.ndarray:
    return np.array(sorted({t for w in set(FIND(text.lower())) for t in terms(w)}), np.int32)


@dataclass
class Machine:
    """Parameters of each place; row 0 is the bias."""

    scale: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def raw(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and sums of vectors of texts, whose rows of the parameters begin at starts; every text has row 0."""
        x = self.scale[rows]
        v = self.vector[rows] * x[:, None]
        total = np.add.reduceat(v, starts)
        return np.add.reduceat(self.weight[rows] * x, starts) + 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(1), total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[np.ndarray], labels: np.ndarray, rank: int = RANK) -> Machine:
    """A machine for texts given as their distinct places."""
    toxic = int(labels.sum())
    prior = float(np.log((toxic + 1) / (len(labels) - toxic + 1)))
    if not toxic or toxic == len(labels):
        return Machine(np.ones(1), np.array([prior]), np.zeros((1, rank)))
    first = [np.flatnonzero(labels == y)[:TRIED] for y in (0, 1)]
    held, rest = np.concatenate([x[4::5] for x in first]), np.concatenate([np.delete(x, np.s_[4::5]) for x in first])
    losses = [np.inf, np.inf]
    if rank and min(len(x) for x in first) >= 5:
        for alike in (False, True):
            m = _fitted([texts[i] for i in rest], labels[rest], rank, alike)
            raw = m.raw(*laid_out(m, [texts[i] for i in held]))[0]
            loss = np.logaddexp(0, np.where(labels[held] == 1, -raw, raw))
            losses[alike] = np.mean([loss[labels[held] == y].mean() for y in (0, 1)])
    return _fitted(texts, labels, rank, losses[1] < losses[0])


def laid_out(m: Machine, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of texts one after another, each behind the bias, and where each begins; places that weigh nothing are left out."""
    rows = [np.r_[0, t[m.scale[t] > 0]] for t in texts]
    return np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])


def _fitted(texts: list[np.ndarray], labels: np.ndarray, rank: int, alike: bool) -> Machine:
    """By AdaGrad on the logistic loss; alike: all places have scale 1."""
    toxic, size = int(labels.sum()), (1 << BITS) + 1
    per = [np.bincount(np.concatenate([texts[i] for i in np.flatnonzero(labels == y)]), minlength=size) for y in (0, 1)]
    ratio = np.log((per[1] + 0.5) / (toxic + 1)) - np.log((per[0] + 0.5) / (len(labels) - toxic + 1))
    scale = np.ones(size) if alike else np.minimum(1, np.abs(ratio) / 3)
    scale[per[0] + per[1] < LEAST_TEXTS] = 0
    scale[0] = 1
    draw = np.random.default_rng(SEED)
    m = Machine(scale, np.zeros(size), draw.normal(0, 0.02, (size, rank)) * (scale > 0)[:, None])
    rows = [np.r_[0, t[scale[t] > 0]] for t in texts]
    squares_w, squares_v = np.full(size, 1e-2), np.full((size, rank), 1e-2)
    heed = len(labels) / (2 * np.array([len(labels) - toxic, toxic]))  # both classes weigh the same
    for _ in range(max(EPOCHS, min(-(-STEPS * BATCH // len(labels)), WORK // sum(map(len, rows))))):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            many = np.array([len(rows[i]) for i in part])
            flat = np.concatenate([rows[i] for i in part])
            raw, total = m.raw(flat, np.cumsum(many) - many)
            error = np.repeat((_sigmoid(raw) - labels[part]) * heed[labels[part]] / len(part), many)
            x = m.scale[flat]
            own, at = np.unique(flat, return_inverse=True)
            slope_w = np.bincount(at, error * x, len(own)) + DECAY * m.weight[own]
            squares_w[own] += slope_w**2
            m.weight[own] -= RATE * slope_w / np.sqrt(squares_w[own])
            if rank:
                each = (error * x)[:, None] * (np.repeat(total, many, axis=0) - m.vector[flat] * x[:, None])
                slope_v = np.stack([np.bincount(at, each[:, j], len(own)) for j in range(rank)], 1) + DECAY * m.vector[own]
                squares_v[own] += slope_v**2
                m.vector[own] -= RATE * slope_v / np.sqrt(squares_v[own])
    return m


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rank: int = RANK) -> Machine:
    """A machine for the labels of docs outside the held-out third."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.col("doc_id"), F.lit(SEED)).alias("place")
    first = [known.where(c).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"), place).orderBy("place", "doc_id").limit(n) for c, n in (("toxic = 1", MAX_TOXIC), ("toxic <> 1", MAX_CLEAN))]
    chosen = first[0].unionAll(first[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [distinct_terms(x) for x in batch["text"].to_pylist()]
            columns = [*(batch[c] for c in ("doc_id", "toxic", "place")), pa.array([len(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "place", "size", "terms"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    found = cut(texts.select("doc_id", "toxic", "place", "text").mapInArrow(run, "doc_id long, toxic int, place long, size long, terms binary"))
    sizes = sorted(found.select("toxic", "place", "doc_id", "size").collect())  # a row for each of the sampled ids
    ends = {y: np.cumsum([r["size"] for r in sizes if r.toxic == y]) for y in (0, 1)}
    taken = {y: int(np.searchsorted(e, MAX_TERMS, side="right")) or 1 for y, e in ends.items()}
    ids = [r.doc_id for y in (0, 1) for r in [r for r in sizes if r.toxic == y][: taken[y]]]
    sample = sorted(found.where(F.col("doc_id").isin(ids)).collect(), key=lambda r: (r.place, r.doc_id)) if ids else []  # bounded by the parameters above
    return fit([np.frombuffer(bytes(r.terms), np.int32) for r in sample], np.array([r.toxic for r in sample], np.int64), rank)


class _Scorer:
    def __init__(self, machine: Machine):
        self.m = machine
        self.codes: dict[str, int] = {}
        self.rows = np.zeros((0, WIDTH), np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.codes) > MEMORY:
            self.codes, self.rows = {}, self.rows[:0]
        found = [set(FIND(x.lower())) for x in texts]
        fresh = list({w for ws in found for w in ws if w not in self.codes})
        if fresh:
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            wide = np.zeros((len(fresh), WIDTH), np.int64)
            for k, w in enumerate(fresh):
                t = terms(w)
                wide[k, : len(t)] = t
            wide[(wide >= len(self.m.scale)) | (self.m.scale[np.minimum(wide, len(self.m.scale) - 1)] == 0)] = 0
            self.rows = np.concatenate([self.rows, wide])
        size = np.array([len(ws) for ws in found])
        code = np.fromiter((self.codes[w] for ws in found for w in ws), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(texts)), size * WIDTH)
        width = len(self.m.weight)
        own = np.unique(np.r_[np.arange(len(texts)) * width, text * width + self.rows[code].ravel()])
        return _sigmoid(self.m.raw(own % width, np.searchsorted(own // width, np.arange(len(texts))))[0])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of docs; other columns are left alone."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by BITS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in batches:
            done = 0
            for part in slices([batch], batch.schema.names[at]):
                yield batch.slice(done, part.num_rows).filter(pa.array(scorer.scores(part.column(at).to_pylist()) < threshold))
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
