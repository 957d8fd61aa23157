"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction, and takes the vectors whose inner product with it exceeds a threshold: those in a cap of the
sphere. The directions are a structured random product code: the rotated space is split into blocks, each has a short list
of random unit vectors, and every combination of one from each block is a direction. So the filters of a vector are listed
by decoding, block by block, dropping combinations that can't reach the threshold any more. Vectors that share a filter meet
and are compared in double precision. The caps narrow as the table grows, so that a bucket's size stays level; the number of
directions is set so that sampled pairs at the limit all share one, a dozen on average.

Equal vectors are one class from the start. A bucket above CHUNK members is split, and every two of its parts meet in a task
of their own. A pair counts only in the first of the filters that it shares, and of a bucket's links only a spanning forest
goes on to the components, so links are never written out pair by pair.

Vectors that are null, zero, empty or hold null or non-finite values link with nothing. Vectors of different lengths are
never linked. Rows that repeat an id are vectors of their own; a null id names a component only if all ids in it are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, forest, table
from inkwell.llm.components import components

COSINE = 0.95
#: Mean number of filters that a pair at the limit shares, and members of a bucket aimed at.
SHARED, BUCKET = 16, 256
#: Independently turned codes, over which the luck of a pair with one of them evens out.
TURNS = 16
#: Buckets are split into parts of about so many members; so many filters are worked on in one group.
CHUNK, GROUP = 1024, 64
SEED = 1


def _tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


@dataclass(frozen=True)
class Caps:
    """turns product codes, each of entries ** blocks directions in dim dimensions, and the threshold of their caps."""

    dim: int
    turns: int
    blocks: int
    entries: int
    threshold: float

    @cached_property
    def _codes(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        out = []
        for k in range(self.turns):
            draw = np.random.default_rng([SEED, self.dim, k])
            turn = np.linalg.qr(draw.normal(size=(self.dim, self.dim)))[0]
            code = []
            for part in np.array_split(np.arange(self.dim), self.blocks):
                c = draw.normal(size=(self.entries, len(part)))
                code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
            out.append((turn, code))
        return out

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors: rows and numbers of all filters exceeded, sorted."""
        rows, numbers = [], []
        for k, (turn, code) in enumerate(self._codes):
            turned = unit @ turn
            scores, at = [], 0
            for c in code:
                scores.append(turned[:, at : at + c.shape[1]] @ c.T)
                at += c.shape[1]
            rest = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]
            row, number, total = np.arange(len(unit)), np.full(len(unit), k, np.int64), np.zeros(len(unit))
            for i, s in enumerate(scores):
                sums = total[:, None] + s[row]
                bound = self.threshold - (rest[i + 1][row] if i + 1 < self.blocks else np.zeros(len(row)))
                r, c = np.nonzero(sums >= bound[:, None])
                row, number, total = row[r], number[r] * self.entries + c, sums[r, c]
            rows.append(row)
            numbers.append(number)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        order = np.lexsort((number, row))
        return row[order], number[order]


def caps_for(dim: int, n: int) -> Caps:
    """Codes for n vectors."""
    share = min(0.02, max(1e-12, BUCKET / max(1, n)))
    low, high = 0.0, 8.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if _tail((low + high) / 2) > share else (low, (low + high) / 2)
    threshold = min(low / math.sqrt(dim), 0.55)
    side = math.sqrt(1 - COSINE**2)
    grid = np.linspace(low, low + 6, 2000)
    joint = float(np.sum(np.exp(-(grid**2) / 2) / math.sqrt(2 * math.pi) * np.array([_tail((low - COSINE * t) / side) for t in grid])) * (grid[1] - grid[0]))
    directions = SHARED / joint / TURNS
    blocks = min(dim, max(2, math.ceil(math.log(max(2, directions)) / math.log(256))))
    entries = max(2, math.ceil(directions ** (1 / blocks)))
    draw = np.random.default_rng([SEED, dim, TURNS])
    x = draw.normal(size=(8000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = COSINE * x + side * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    while True:
        caps = Caps(dim, TURNS, blocks, entries, threshold)
        if dim == 1 or _shared(caps, x, y) > 0:
            return caps
        entries = math.ceil(entries * 1.1)


def _shared(caps: Caps, x: np.ndarray, y: np.ndarray) -> int:
    """The least number of filters that a row of x shares with that of y."""
    least = []
    for k in range(0, len(x), 250):
        n = len(x[k : k + 250])
        (r, f), (s, g) = caps.decode(x[k : k + 250]), caps.decode(y[k : k + 250])
        names = np.unique(np.concatenate([f, g]))
        both = np.intersect1d(r * len(names) + np.searchsorted(names, f), s * len(names) + np.searchsorted(names, g))
        least.append(np.bincount(both // max(1, len(names)), minlength=n).min())
    return int(min(least))


def _matrix(vectors: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _links(unit: np.ndarray, size: np.ndarray, caps: Caps, own: int, part: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's members: weight of the links first met in filter own, and the least member linked to."""
    hit = np.zeros((0, 2), np.int64)
    found = []
    split = part.min() != part.max()
    for k in range(0, len(unit), CHUNK):
        near = unit[k : k + CHUNK] @ unit.T >= cosine
        a, b = np.nonzero(near)
        a += k
        go = (a < b) & ((part[a] != part[b]) if split else True)
        found.append(np.stack([a[go], b[go]], 1))
    hit = np.concatenate(found) if found else hit
    a, b = hit[:, 0], hit[:, 1]
    first = np.ones(len(a), bool)
    if len(a):
        used = np.unique(hit)
        slot = np.zeros(len(unit), np.int64)
        slot[used] = np.arange(len(used))
        row, number = caps.decode(unit[used])
        row, number = row[number < own], number[number < own]  # a pair with such a filter in common has met before
        names, codes = np.unique(number, return_inverse=True)
        if len(names):
            has = np.zeros((len(used), len(names)), np.float32)
            has[row, codes] = 1
            for k in range(0, len(used), CHUNK):
                met = has[k : k + CHUNK] @ has.T > 0
                some = (slot[a] >= k) & (slot[a] < k + CHUNK)
                first[some] = ~met[slot[a[some]] - k, slot[b[some]]]
    weight = np.bincount(a[first], size[b[first]], len(unit)) + np.bincount(b[first], size[a[first]], len(unit))
    return weight.astype(np.int64), forest(a, b, len(unit))


def read_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, class (a 64-bit name of the values, null for vectors that link with nothing), dim and raw values."""
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            raw: list[bytes | None] = []
            for i in range(len(lists)):
                values = lists[i].values if lists[i].is_valid else None
                x = None
                if values is not None and len(values) and not values.null_count:
                    x = np.asarray(values.to_numpy(zero_copy_only=False), kind) + 0  # -0 becomes 0
                raw.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            name = [None if x is None else np.array([xxhash.xxh3_64_intdigest(x)], np.uint64).astype(np.int64)[0] for x in raw]
            dim = [None if x is None else len(x) // kind().itemsize for x in raw]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(name, pa.int64()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "class", "dim", "raw"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding")).mapInArrow(run, "vec_id long, class long, dim int, raw binary")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    rows = cut(read_vectors(vectors))
    classes = cut(rows.where("class is not null").groupBy("class").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count("*").alias("size"), F.min("vec_id").alias("first_id")))
    codes = {r["dim"]: caps_for(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                dims = part["dim"].to_numpy()
                for dim in np.unique(dims):
                    batch = part.filter(pa.array(dims == dim))
                    row, number = codes[dim].decode(_unit(_matrix(batch["raw"].to_pylist(), kind)))
                    ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(number, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=["class", "dim", "filters"])

    met = cut(classes.select("class", "dim", "raw").mapInArrow(decode, "class long, dim int, filters array<long>"))
    met = met.select("class", "dim", F.explode("filters").alias("filter"))
    counts = met.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    counts = cut(counts.select("dim", "filter", F.ceil(F.col("n") / CHUNK).alias("parts")))
    inside = met.join(counts, ["dim", "filter"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    inside = inside.select("class", "filter", "dim", "parts", "part", other.alias("other"))
    group = F.when(F.col("parts") > 1, -1 - F.col("filter")).otherwise(F.floor(F.col("filter") / GROUP))
    inside = inside.select("class", "dim", "filter", "part", group.alias("key"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    inside = inside.join(classes.select("class", "raw", "size"), "class")

    def compare(bucket: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = bucket["filter"].to_numpy()
        order = np.argsort(number, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(at) < 2:
                continue
            t = bucket.take(pa.array(at))
            names = t["class"].to_numpy()
            weight, root = _links(_unit(_matrix(t["raw"].to_pylist(), kind)), t["size"].to_numpy(), codes[t["dim"][0].as_py()], int(number[at[0]]), t["part"].to_numpy(), cosine)
            hit = np.flatnonzero(weight)
            tied = np.flatnonzero(root != np.arange(len(root)))
            out += [(names[hit], names[hit], weight[hit]), (names[tied], names[root[tied]], np.zeros(len(tied), np.int64))]
        a, b, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": a, "b": b, "n": n})

    found = cut(inside.groupBy("dim", "key", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("links"))
    joined = components(found.select("a", "b"))
    own = classes.select("class", "size", "first_id").join(joined.withColumnRenamed("node", "class"), "class", "left").join(links.withColumnRenamed("a", "class"), "class", "left")
    own = cut(own.select("class", "first_id", F.coalesce("component", "class").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = cut(own.groupBy("component").agg(F.min("first_id").alias("least_id")))
    ids = cut(own.join(least, "component").select("class", "n_links", "least_id"))
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    out = rows.select("vec_id", "class").join(ids, "class", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
own AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN own USING (vec_id)"""
