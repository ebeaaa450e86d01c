"""Byte-level helpers shared by the operators of this subpackage.

Texts reach Python as Arrow string arrays; the helpers expose an array's bytes and offsets without
copying, cut them into blocks of bounded size and hash words in bulk, so that the cost of a text is a
few vectorised passes and the memory of a task depends on the block size, not on the batch.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised pass takes at once.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the column's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def as_strings(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null becomes the empty text)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.string())
    return array.fill_null("") if array.null_count else array


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and each text's start (with the end of the last)."""
    array = as_strings(array)
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, width)[array.offset : array.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * BLOCK_BYTES:
            _POWERS[kind] = have
    return have[:n]


#: Bytes that belong to words: digits, letters and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
WORD_BYTE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, and where each text's words start (with the end).

    Words are runs of ASCII letters and digits (A-Z as a-z) and non-ASCII characters. The hash of a word
    is a polynomial over its bytes, taken from one running sum for all of them, then finalised.
    """
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = WORD_BYTE[body]
    # a text's last word ends where the next text starts
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    ends = np.flatnonzero(last) + 1
    terms = (_LOWER[body].astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers("down", _BACK, n)[starts]
    h = mix64(h ^ (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets, side="left")


def spread(counts: np.ndarray) -> np.ndarray:
    """0,0,..,1,1,.. with each position repeated as often as counted."""
    return np.repeat(np.arange(len(counts)), counts)


def tidy() -> None:
    """Give a Python worker's unused memory back; idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def free(df: DataFrame, *names: str) -> None:
    """Raise ValueError where ``df`` has a column of one of the names already."""
    taken = {*names} & {*df.columns}
    if taken:
        raise ValueError(f"the table has columns of these names already: {', '.join(sorted(taken))}")


#: Rows and bytes of an Arrow batch at most; texts may be long, and a batch is in memory several times.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 21


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python functions, unless they are smaller already.

    The setting stays in the session: Spark reads it when a result is computed."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key).rstrip("bB")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's own; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="quillcheck-checkpoint-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the checkpoint folder and read back, and the table's path."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def unstash(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stash`` has written and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
