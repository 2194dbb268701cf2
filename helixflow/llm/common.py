"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most where whole texts go to Python, so that a batch of long texts fits in memory.
BATCH_ROWS = 1000
#: Bytes of text that are hashed at once; eight bytes for each stay in a core's cache.
PIECE = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's own bound on the rows of an Arrow batch to BATCH_ROWS, where it is higher or off."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for tables without texts, until the block ends."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only in local mode where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "scratch_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark deletes the shuffle files of finished jobs only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. Far faster than ``np.unique`` on many whole numbers, where that goes through a hash table."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def first_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and a place where each is."""
    order = np.argsort(x)
    x = x[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return x[first], order[first]


def texts_as_bytes(column) -> list:
    """An Arrow string column as UTF-8 bytes; None stays None."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


#: Words are hashed by polynomials in a random odd base over random codes of bytes; A-Z count as a-z.
BASE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CODE[65:91] = _CODE[97:123]


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to size - 1 of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:
            n = min(done, size - done)
            p[done : done + n] = p[:n] * np.uint64(pow(base, done, 1 << 64))
            done += n
        out.append(p)
    return out[0], out[1]


def word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and where each text's words start (one more entry than texts). data: their
    bytes, one text after another; begin: where each starts, and the end of the last."""
    space = (data == 32) | ((data - np.uint8(9)) < 5)
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = begin[:-1][begin[:-1] < len(data)]
    first[edge] = word[edge]
    edge = edge[edge > 0] - 1
    last[edge] = word[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(1 << max(18, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start]), np.searchsorted(start, begin)


def word_pieces(column, piece: int = PIECE):
    """(first row, word hashes, offsets of rows in them) for runs of rows of an Arrow string column, of about ``piece``
    bytes. Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; null is empty. A longer text is hashed in parts, cut at
    white space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + piece, side="right")) - 1)
        low, high = int(at[row]), int(at[stop])
        if high - low <= piece:
            yield (row, *word_hashes(data[low:high], at[row : stop + 1] - low))
        else:
            found = []
            while low < high:
                end = min(low + piece, high)
                while end < high:  # to the next white space
                    space = np.flatnonzero(_SPACE[data[end : end + piece]])
                    end = min(end + (int(space[0]) if len(space) else piece), high)
                    if len(space):
                        break
                found.append(word_hashes(data[low:end], np.array([0, end - low]))[0])
                low = end
            w = np.concatenate(found)
            yield row, w, np.array([0, len(w)])
        row = stop


def word_id(word: bytes) -> int:
    """The hash that one word has in ``word_pieces``."""
    return int(word_hashes(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])
