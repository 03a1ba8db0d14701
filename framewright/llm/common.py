"""What the operators of this subpackage share: written tables, blocks, words and 64-bit hashing.

Words are the maximal runs of bytes outside space and \\x09-\\x0D, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that one step of a Python worker handles together.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where the session names none, a temporary one if all
    executors are in this process; else it fails, as a folder of one machine would be lost to the others."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors; deleted by ``discard``
    or when the session ends. What the query shuffled is deleted as soon as the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framewright/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _TABLES[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: Whether Spark deletes a query's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: dict[str, SparkSession] = {}


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that no later step reads, and lets Spark drop the shuffle files of finished jobs."""
    for df in tables:
        spark = _TABLES.pop(getattr(df, "written_path", None), None)
        if spark is not None:
            _delete(spark, df.written_path)
    gc.collect()
    jvm = SparkSession.getActiveSession()
    if jvm is not None:
        jvm.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _TABLES.items():
        _delete(spark, path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes behind ``df``; 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where it is a scan of fewer files than there are cores and so small that these can't be split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if plan_bytes(df) < split * cores and 0 < len(df.inputFiles()) < cores else df


def block_count(df: DataFrame, block_bytes: int = 8 << 20) -> int:
    """How many blocks of about ``block_bytes`` the rows go to; in proportion to the input, several to a shuffle partition."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df) // block_bytes, 1)


def block_of(key: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(blocks)).cast("int")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null: empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``most`` text bytes (a longer text alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def _finish(x: np.ndarray) -> np.ndarray:
    """Mixes the 64-bit numbers in place; bijective."""
    t = x >> U64(32)
    x ^= t
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(29), out=t)
    x ^= t
    x *= U64(0x94D049BB133111EB)
    np.right_shift(x, U64(32), out=t)
    x ^= t
    return x


def give_back() -> None:
    """Returns freed memory to the system (where its C library can), for workers that live on between stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer; another one for each salt."""
    return _finish(x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1)))


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of the ordered pair of hashes."""
    x = a * U64(0xD6E8FEB86659FD93)
    t = b * U64(0xA0761D6478BD642F)
    x += t
    x += U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    return _finish(x)


def window_hash(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of ``size`` consecutive entries, by doubling."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    runs, out, done, width = mix(words, salt), None, 0, 1
    while True:
        if size & width:
            out = runs if out is None else pair_hash(out[: len(words) - done - width + 1], runs[done : len(words) - width + 1], salt + 7)
            done += width
        if done == size:
            return out[: len(words) - size + 1]
        runs = pair_hash(runs[: len(runs) - width], runs[width:], salt + 3)
        width *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 256


def hash_ranges(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of each range of bytes; ``data`` has 8 bytes more than the ranges need."""
    size = last - first
    eight = np.ndarray((max(1, len(data) - 7),), "<u8", data.data, 0, (1,))
    hashes = mix(eight[first] & _LOW_BYTES[np.minimum(size, 8)], 900)
    hashes += size.astype(np.uint64)
    todo, done = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
    while len(todo):
        more = eight[first[todo] + done] & _LOW_BYTES[np.minimum(size[todo] - done, 8)]
        hashes[todo] = pair_hash(hashes[todo], more, 901)
        done += 8
        todo = todo[size[todo] > done]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]])
    return hashes


class Tokens:
    """The words of some texts one after another: the hash and the text of each, and each text's first word, end and count.

    Words are hashed 8 bytes at a time, all words together; a word of up to 8 bytes has a hash that no other such word has.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        data = b"\n".join(texts) + b"\n        "
        raw = np.frombuffer(data, np.uint8)[:-8]
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.first, self.last = edge[0::2], edge[1::2]  # the words' bytes in the run of all texts
        self.hashes = hash_ranges(np.frombuffer(data, np.uint8), self.first, self.last)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.ends = np.searchsorted(self.first, ends)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(texts) else self.ends
        self.counts = self.ends - self.starts
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def whole(self, size: int) -> np.ndarray:
        """For each window of ``size`` words of the run of all words: whether it lies in one text."""
        n = len(self.hashes) - size + 1
        return self.text[:n] == self.text[size - 1 :] if n > 0 else np.empty(0, bool)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` positions lie in one of the windows of ``size`` that begin at ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, np.minimum(starts + size, n), 1)
    return np.cumsum(step[:-1]) > 0
