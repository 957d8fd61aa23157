"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import ship

#: Characters between words: space and the five ASCII controls U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes that a vectorised pass takes at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes of a batch on its way between Spark and a Python worker.
BATCH_BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Have Spark send Python workers batches of BATCH_BYTES (or one row, if longer) instead of 64 MB, which a JVM holds outside
    its heap, up to twice over as buffers grow, for each of its running tasks. A smaller bound of the session's own stays."""
    bound = spark.conf.get(BATCH_BOUND)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bound) > BATCH_BYTES:
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))


#: Folders of sessions of one machine that have none of their own; the setting itself can't be changed once a session runs.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; made here only where a session of one machine has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
    return _FOLDERS[app]


#: Sessions, paths, and the names of those that are tables of the catalog.
_WRITTEN: list[tuple[SparkSession, str, str | None]] = []


def _clean() -> None:
    for spark, path, name in _WRITTEN:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_table(spark, path)
        except Exception:  # the session may have ended, and its folder with it
            return


def _written(spark: SparkSession, path: str, name: str | None = None) -> None:
    if not _WRITTEN:
        atexit.register(_clean)  # registered after Spark's own, so that it runs before
    _WRITTEN.append((spark, path, name))


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, so a lost executor costs
    only the tasks after it. Unlike checkpoint(), it runs the plan once and keeps the columns prunable."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str) -> DataFrame:
    """As cut(), the rows dealt by key and written in buckets: joins on key then move only their other side. It is a table of
    the session's catalog until the process ends, since only such tables keep their buckets."""
    spark = df.sparkSession
    name = f"inkwell_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    _written(spark, path, name)
    del df
    forget_shuffles(spark)
    return spark.table(name)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; it finds them when the JVM collects."""
    spark.sparkContext._jvm.System.gc()


def unused(name: str, df: DataFrame) -> str:
    """A column name like name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in pieces whose texts have about limit bytes; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        batch = batch.set_column(at, column, text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array one after another, and the n + 1 offsets of its rows in them."""
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and the n + 1 offsets of rows in these; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    both = edges[inside[edges] & inside[edges + 1]]
    begins[both] = True
    ends[both] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each span of data, the same wherever the span stands. Spans come in order of their starts; block
    bounds the bytes hashed at once, unless one span is longer."""
    if len(data) > block and len(starts) > 1:
        out, k = np.zeros(len(starts), np.uint64), 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(starts, starts[k] + block)))
            a, b = int(starts[k]), int(ends[k:last].max())
            out[k:last] = span_hashes(data[a:b], starts[k:last] - a, ends[k:last] - a, b - a + 1)
            k = last
        return out
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive values of h; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(_BASE)
        out += h[k : len(h) - n + 1 + k]
    return mix64(out)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid out one after another: each member's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of size places lie in one of the spans."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, ends, 1)
    return np.cumsum(step)[:-1] > 0


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member reachable from each of n members over the links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def ascii_lower(column) -> object:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
