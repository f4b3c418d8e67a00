"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and Python regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64


def scratch(spark: SparkSession) -> str:
    """The shared folder for cut lineage: spark.checkpoint.dir, or a new one in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="cairnlake-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages survive the loss of any executor."""
    path = f"{scratch(df.sparkSession)}/cairnlake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    fs, at = _stored(df.sparkSession, path)
    fs.deleteOnExit(at)
    for made in _WATCHED:
        made.append(path)
    return out


def _stored(spark: SparkSession, path: str):
    """The file system and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def forget(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these; nothing that is still to be computed may depend on them."""
    for df in tables:
        fs, at = _stored(df.sparkSession, df.cut_path)
        fs.delete(at, True)


#: Lists of watched() that are open.
_WATCHED: list[list[str]] = []


@contextlib.contextmanager
def watched(spark: SparkSession):
    """Deletes at its end what cut() has written meanwhile, but for the tables that the caller names in the list it gets."""
    made, kept = [], []
    _WATCHED.append(made)
    try:
        yield kept
    finally:
        _WATCHED[:] = [x for x in _WATCHED if x is not made]
        for path in made:
            if path not in {df.cut_path for df in kept}:
                fs, at = _stored(spark, path)
                fs.delete(at, True)


#: Bytes of one batch between the JVM and Python, so that the buffers of both stay small whatever the length of texts.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the batches of Arrow functions in bytes; a bound that the session sets itself stays."""
    if spark.conf.get(BATCH, None) == "67108864b":  # the default
        spark.conf.set(BATCH, size)


def release(collect: bool = True) -> None:
    """Give free memory back to the system: Spark keeps idle Python workers beside the memory of later stages."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """An Arrow function over batches that releases the worker's memory when it ends."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within max_rows; otherwise unmarked, and joins shuffle it."""
    return F.broadcast(df) if df.count() <= max_rows else df


def fold(column: str, divisor: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` modulo `divisor`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor == rest, F.lit(False))


def word_count(text: Column) -> Column:
    """Number of words; one character stands for each, so that no list of words is made."""
    plain = F.rtrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(plain, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "w")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Numbered(dict):
    """Numbers words in the order of their first use; `new` lists those that were added last."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: Iterable, count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, count)

    def taken(self) -> list:
        out, self.new = self.new, []
        return out


class WordHashes(dict):
    """64-bit hashes of words, kept for the most recent `limit` distinct ones."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=_U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x
