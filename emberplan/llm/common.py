"""Shared helpers: work folders, size-checked broadcasts and vectorised text access."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: A broadcast array may have this many 8-byte entries (32 MB); beyond it the callers join.
BROADCAST_ENTRIES = 4_000_000
#: Vectorised text steps work on slices of about this many bytes (one document may exceed it). They
#: hold some dozens of bytes for each of them.
SLICE_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberplan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/emberplan-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while; those that this Spark doesn't know are left out."""
    usual = {}
    for k, v in values.items():
        with contextlib.suppress(Exception):
            usual[k] = spark.conf.get(k, None)
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in usual.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Arrow batches of whole texts: few rows and bytes at once keep Python workers and executors small.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(4 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches where they are Spark's own.

    The setting stays, since operators give plans that run later: with whole texts a batch of
    Spark's usual size takes hundreds of MB outside the heap, which an executor never gives back.
    """
    for k, (usual, small) in SMALL_BATCHES.items():
        if spark.conf.get(k, usual) == usual:
            spark.conf.set(k, small)


_OPEN: list[str] = []  # folders of the scratch() blocks that are open, outermost first


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that materialise() writes inside are deleted at the end, but for those with keep=True."""
    _OPEN.append(work_dir(spark))
    try:
        yield
    finally:
        delete(spark, _OPEN.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder that this session wrote and needs no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffles of the write go once it has ended. Small partitions are joined to the advised
    size, so that a small table is a file or two.
    keep: it outlives the scratch() block that it is written in.
    """
    spark = df.sparkSession
    around = _OPEN[:-1] if keep else _OPEN
    path = f"{around[-1]}/{uuid.uuid4().hex}-{name}" if around else f"{work_dir(spark)}/{name}"
    small_batches(spark)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """A function for mapInArrow that gives memory back when its task is over: workers live on."""

    def ran(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(Exception):
                ctypes.CDLL(None).malloc_trim(0)

    return ran


def collect_garbage(spark: SparkSession) -> None:
    """Lets every executor collect its whole heap, by one short task a core.

    A heap grows to its limit on garbage and keeps that size while Python workers, outside of it,
    need room; after a full collection it is as small as what it holds. Where Spark forbids
    reflect(), nothing happens.
    """
    n = spark.sparkContext.defaultParallelism
    with contextlib.suppress(PySparkException):
        spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising hash of uint64 values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, most: int = SLICE_BYTES):
    """(first row, offsets, bytes) pieces of an Arrow string array; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


def word_spans(off: np.ndarray, data: np.ndarray, space: np.ndarray = SPACES):
    """Starts and ends of words (runs without ASCII white space), and word offsets by row."""
    word = ~space[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        edge = off[(off > 0) & (off < len(data))]
        before[edge] = False
        after[edge - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.tobytes(), strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix((eight[starts] & LOW_BYTES[np.minimum(size, 8)]) + np.uint64(0x9E3779B97F4A7C15) * size.astype(np.uint64))
        left = np.flatnonzero(size > 8)
        at = 8
        while len(left):
            part = eight[starts[left] + at] & LOW_BYTES[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(1))
            at += 8
            left = left[size[left] > at]
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes (windows may cross rows; callers mask)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, k):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += words[j : j + n]
    return mix(h)
