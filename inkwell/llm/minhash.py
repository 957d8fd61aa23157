"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2**32 shingle numbers make all coordinates of a signature: the first deals out the
shingles, the second, shifted circularly by one more place for each coordinate, ranks them. Bands of four coordinates are
buckets; there are enough of them that a pair at the threshold is missed once in a hundred thousand.

Texts with equal sets are one class from the start. Within a bucket every class is compared with its least one; what that
links is joined into components. Only buckets whose members are then in different components need more: there all members
are compared with those in other components, in parts of bounded size, and only a spanning forest of the links leaves a
task. So no pair of a bucket goes unjudged unless it is linked anyway, and no pairs are written out.

Words are split at ASCII spaces and A-Z lower-cased. Shingles have 64-bit hashes, compared in full sets. A text with fewer
words than a shingle is one shingle as a whole; one without words, or null, is linked with nothing. Rows that repeat an id
are documents of their own; a null id never names a component unless all ids in it are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, flat, forest, forget_shuffles, gram_hashes, mix64, placed, slices, span_hashes, table, unused, words
from inkwell.llm.components import components

ROWS, MISSED = 4, 1e-5
#: Buckets are compared in parts of about so many members.
CHUNK = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = flat(text)
    data = _LOWER[data]
    starts, ends, rows = words(data, offsets)
    h = span_hashes(data, starts, ends)
    grams = gram_hashes(h, n)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], b - a) + np.uint64(b - a))  # never equal to a full shingle but by chance
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rank(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures of non-empty sets, a row each."""
    counts = np.array([len(s) for s in sets])
    dealt = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    return np.stack([np.minimum.reduceat(_rank(dealt + np.uint32(k)), starts) for k in range(size)], 1)


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64)) if len(s) else 0


def signed(docs: DataFrame, n: int, bands: int) -> DataFrame:
    """row_key, doc_id, n_shingles, class (null for an empty set) and bands of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"], n)
            full = [i for i, s in enumerate(sets) if len(s)]
            values: list = [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full], bands * ROWS).reshape(len(full), bands, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2])
                for k in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
                for i, row in zip(full, key.view(np.int64)):
                    values[i] = row
            columns = [batch["row_key"], batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_key", "doc_id", "n_shingles", "class", "bands"])

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, "row_key long, doc_id long, n_shingles long, class long, bands array<long>")


def _sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """class and set of the rows of docs that needed (row_key, class) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch["text"], n)
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])

    found = docs.select("row_key", "text").join(needed, "row_key").select("text", "class").mapInArrow(run, "class long, set binary")
    return found.groupBy("class").agg(F.first("set").alias("set"))  # rows that repeat id and text


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    two = one.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    return two.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _between(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that span all links between members of one bucket in different components.

    members: bucket, class, component, parts and part. Every two parts of a bucket meet in one task, and small buckets share
    tasks. What two sets have in common is counted for all pairs at once, as a product of their incidences."""
    groups = max(256, members.count() // 1024)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    placed = members.select("bucket", "class", "component", "parts", "part", other.alias("other"))
    key = F.when(F.col("parts") > 1, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(groups)))
    placed = placed.select("bucket", "class", "component", "part", key.alias("key"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    def compare(rows: pa.Table) -> pa.Table:
        number = rows["bucket"].to_numpy()
        order = np.argsort(number, kind="stable")
        out = [np.zeros((0, 2), np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            t = rows.take(pa.array(at))
            names = t["class"].to_numpy()
            a, b = _alike([np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()], t["component"].to_numpy(), percent)
            root = forest(a, b, len(names))
            tied = np.flatnonzero(root != np.arange(len(root)))
            out.append(np.stack([names[tied], names[root[tied]]], 1))
        both = np.concatenate(out)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return placed.join(sets, "class").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _alike(sets: list[np.ndarray], component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets in different components that are as similar as asked."""
    size = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[code] > 1
    column = np.cumsum(count > 1) - 1
    row, code = row[shared], column[code[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, (1 << 24) // len(sets))
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for k in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [k, k + step])
        has = np.zeros((len(sets), min(step, int(code[-1]) + 1 - k)), np.float32)
        has[row[a:b], code[a:b] - k] = 1
        both += has @ has.T
    near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (component[:, None] != component[None, :])
    return np.nonzero(np.triu(near, 1))


def row_key() -> Column:
    """A 64-bit name of a row's id and text."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    return _judged(placed(docs.select("doc_id", "text", row_key().alias("row_key")), "row_key"), n, percent).drop("row_key", "leads", "alone")


def _judged(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """As near_duplicates, with row_key, for docs placed by row_key; leads: whether the row is, but for rows that repeat its
    id and text, the one that stands for its component. A row linked with nothing for lack of words leads, too."""
    rows = cut(signed(docs, n, n_bands(percent)))
    lead = F.min_by(F.struct("doc_id", "row_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    classes = cut(rows.where("class is not null").groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), lead.alias("lead")).select("class", "n", "bands", "lead.*"))
    entries = classes.select("class", "n", F.explode("bands").alias("bucket"))
    buckets = cut(entries.groupBy("bucket").agg(F.min("class").alias("a"), F.min_by("n", "class").alias("n_a"), F.count("*").alias("size")).where("size > 1").select("bucket", "a", "n_a"))
    members = cut(entries.join(buckets, "bucket"))

    alike = f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
    pairs = cut(members.where(f"class <> a and {alike}").select("a", F.col("class").alias("b")).distinct())
    used = members.select("class").distinct()
    sets = cut(_sets(docs, classes.join(used, "class").select("row_key", "class"), n))
    forget_shuffles(docs.sparkSession)
    edges = cut(_verified(pairs, sets, percent))
    found = components(edges)

    named = cut(members.select("bucket", "class", "n").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    spread_out = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    mixed = cut(spread_out.select("bucket", F.ceil(F.col("size") / CHUNK).alias("parts")))
    inside = cut(named.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))))
    more = cut(_between(inside, sets, percent))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    joined = classes.select("class", F.col("doc_id").alias("first_id"), F.col("row_key").alias("first_key")).join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    joined = cut(joined)
    lead_key = F.min_by("first_key", F.struct(F.col("first_id").isNull(), "first_id", "first_key"))
    least = cut(joined.groupBy("component").agg(F.min("first_id").alias("least_id"), lead_key.alias("lead_key")))
    ids = cut(joined.join(least, "component").select("class", "least_id", "lead_key"))
    out = rows.join(ids, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return out.select("row_key", "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), (F.col("class").isNull() | (F.col("row_key") == F.col("lead_key"))).alias("leads"), F.col("class").isNull().alias("alone"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of docs, with all its columns, and the rows without words, which are linked with nothing.

    The row has the least id, not null if any isn't; of rows that repeat its id and text the one least in all columns stays."""
    key, names = unused("row_key", docs), docs.columns
    whole = placed(docs.withColumn(key, row_key()), key)
    judged = cut(_judged(whole.select("doc_id", "text", F.col(key).alias("row_key")), n, percent).select(F.col("row_key").alias(key), "leads", "alone"))
    gone = judged.where("not leads").select(key).distinct()
    again = cut(judged.where("leads and not alone").groupBy(key).count().where("count > 1").select(key))
    if again.isEmpty():
        return whole.join(cut(gone), key, "left_anti").select(names)
    once = whole.join(cut(gone.unionAll(again)), key, "left_anti").select(names)
    first = whole.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return once.unionAll(first)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS t(i) WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hits AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM hits JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN both_ways e ON r.y = e.a) SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, w.doc_id) AS component_id, w.doc_id = coalesce(least, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.x = w.doc_id"""
