"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, and word hashing.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir`` (any Hadoop file system), so
that they outlive a lost executor. Only a local session that lacks that setting, as in tests, gets a temporary folder.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.lineage import shared_folder

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 21

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder of the session."""
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}"
    atexit.register(_forget_quietly, spark, path)
    return path


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path, by the driver's JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


def _forget_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        forget(spark, path)


def keep(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and a lost executor costs nothing.

    Shuffle files of the write are removed once it has ended. The result's path is in its ``tessera_path``.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def give_back() -> None:
    """Returns what a worker has freed to the system. Workers outlive their tasks, and each keeps its peak otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------------------------------------------- word hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _noise(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
_BYTE = _noise(256, 1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_IS_SPACE] = 0
_PLACE = _noise(256, 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _noise(1 << int(n - 1).bit_length(), 2) | np.uint64(1)
    return _PLACE


def _hash_bytes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in concatenated texts, and the position at which each begins."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    first = starts_of_texts[starts_of_texts < len(data)]
    begins[first] |= ~space[first]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), at
    lengths = np.diff(at, append=len(data))
    place = np.arange(at[0], len(data)) - np.repeat(at, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE[data[at[0] :]] * _places(int(lengths.max()))[place]
        return mix64(np.add.reduceat(value, at - at[0])), at


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and offsets: words of text i are ids[offsets[i]:offsets[i+1]].

    A word is a run of bytes other than ``SPACES``; A-Z count as a-z. Null is an empty text. Hashes are the same in
    every process. Distinct words collide with a chance of about 2**-63 a pair.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    _, where, raw = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    ids, counts, i = [], np.zeros(n, np.int64), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_BYTES, "right")) - 1)
        got, at = _hash_bytes(data[ends[i] : ends[j]], ends[i:j] - ends[i])
        ids.append(got)
        counts[i:j] = np.diff(np.searchsorted(at, ends[i : j + 1] - ends[i]))
        i = j
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one come to about ``limit`` bytes (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        i = 0
        while i < batch.num_rows:
            base = int(size[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
