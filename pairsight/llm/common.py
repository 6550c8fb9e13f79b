"""What the text operators share: written cuts of lineage, chunks of documents, packed rows.

A *chunk* is a bounded piece of a partition (whole documents up to a number of
bytes). Operators that must meet equal pieces of text settle what they can inside a
chunk and send one packed row per (flush, bucket) to the shuffle, so a group of
copies costs one entry per chunk however many rows it has.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows in a batch between the JVM and Python.
BATCH = 1000
#: Paths of the tables that ``cut`` wrote in this process and that are still there.
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pairsight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors repeat no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dealt_once(df: DataFrame) -> DataFrame:
    """The rows of ``df`` over the shuffle files of one run, however many jobs read them.

    Nothing is copied and lineage is kept: files of a lost executor are made again. They go when the frame is no longer referred to.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def remove(spark: SparkSession, paths: set[str]) -> None:
    """Delete tables that ``cut`` wrote."""
    jvm = spark.sparkContext._jvm
    for path in paths & _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.discard(path)


def forget(*frames: DataFrame) -> None:
    """Remove the tables behind what ``cut`` returned, once nothing reads them any more."""
    for frame in frames:
        remove(frame.sparkSession, {getattr(frame, "written_to", "")})


def clear_cuts(spark: SparkSession) -> None:
    """Remove every table that ``cut`` wrote in this process; results not yet written can't be read after it."""
    remove(spark, set(_WRITTEN))


@lru_cache(1)
def _libc():
    """The C library, told to give large freed blocks back at once; None where there is another."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # from 1 MB blocks are mapped, and unmapped when freed
        libc.mallopt(-1, 4 << 20)
        return libc
    except (OSError, AttributeError):
        return None


def frugal(work: Callable) -> Callable:
    """``work`` for mapInArrow, whose worker keeps no freed memory: idle workers stay beside the next stage's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        try:
            yield from work(batches)
        finally:
            if libc:
                libc.malloc_trim(0)

    run.__name__ = work.__qualname__.split(".")[0]  # plans show it
    return run


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text in UTF-8 (null: empty), and no other column.

    Rows go to Python by BATCH at most: a session's larger setting is lowered, since a batch is held whole.
    """
    conf = docs.sparkSession.conf
    held = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if held <= 0 or held > BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body, *more)


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, texts) of at most ``limit`` bytes, or of one document that is longer."""
    ids: list = []
    bodies: list[bytes] = []
    held = 0
    for batch in batches:
        for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if held and held + len(body) > limit:
                yield ids, bodies
                ids, bodies, held = [], [], 0
            ids.append(doc)
            bodies.append(body)
            held += len(body)
    if ids:
        yield ids, bodies


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted. By sorting: NumPy's own way hashes, which takes many times as long."""
    values = np.sort(values)
    return values[starts_of(values)]


def buckets_for(docs: DataFrame, piece: int) -> int:
    """As many buckets as the texts have pieces of so many bytes, and one for each shuffle partition at least.

    Counted from the texts themselves, so that a bucket's share is the same at every size.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_parts(docs.sparkSession), size // piece + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: running minima from both ends of blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then the same for the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first.astype(np.int64) - at, count)
