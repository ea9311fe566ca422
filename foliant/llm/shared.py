"""What the operators of this subpackage share: the shared folder, written tables, and vectorised word hashing.

``workdir`` follows ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder.
The numpy helpers work on the raw UTF-8 buffers of Arrow string arrays, in chunks of whole texts, so their memory
is bounded by the chunk (or by one text, if that is longer).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.workers import importable

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For the allocators of Python workers: one arena, and Arrow uses it too.
LEAN = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(1 << 25), "MALLOC_MMAP_THRESHOLD_": str(1 << 24), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound what they hold: the bytes of a batch, and what the allocator
    keeps of freed memory. The session keeps these settings, as plans are only run later."""
    importable(spark)
    if spark.conf.get(BATCH_BYTES, None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        spark.conf.set(BATCH_BYTES, "4m")
    for k, v in LEAN.items():
        spark.sparkContext.environment.setdefault(k, v)


def lean(f):
    """A function of batches that gives freed memory back when its task ends, as the worker lives on."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(_libc(), "malloc_trim", None)) is not None:
                trim(0)

    return run


@cache
def _libc():
    return ctypes.CDLL(None)


@cache
def _local_dir() -> str:
    d = tempfile.mkdtemp(prefix="foliant-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    return "file://" + d


def workdir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session that names none."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffle files of what is out of use."""
    for t in tables:
        for f in {x.rpartition("/")[0] for x in t.inputFiles()[:1]}:
            if f.removeprefix("file:").lstrip("/").startswith(workdir(spark).removeprefix("file:").lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Written tables that are deleted together once nothing reads them any more."""

    #: After so many tables, what the driver no longer refers to is collected, and with it go its shuffle files.
    EVERY = 4

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.parts = spark, [], []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = new_dir(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        if len(self.paths) % self.EVERY == 0:
            gc.collect()
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def inner(self) -> Scratch:
        """One that may be dropped before, and is dropped with this one."""
        self.parts.append(Scratch(self.spark))
        return self.parts[-1]

    def drop(self) -> None:
        for part in self.parts:
            part.drop()
        for p in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths, self.parts = [], []
        gc.collect()
        self.spark._jvm.System.gc()


def unused(name: str, taken: list[str]) -> str:
    """A column name like this one that is not taken, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    b, o = b[o[0] : o[-1]], o - o[0]
    if texts.null_count:  # a null may cover bytes
        lens = np.where(np.asarray(texts.is_valid()), np.diff(o), 0)
        if lens.sum() != len(b):
            keep = np.repeat(np.asarray(texts.is_valid()), np.diff(o))
            b = b[keep]
        o = np.concatenate([[0], np.cumsum(lens)])
    return b, o


def chunks(o: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; at least one text each."""
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_rng = np.random.default_rng(20240229)
#: A random number for each byte; A-Z have those of a-z where case is folded.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _pow.get(base)
    if got is None or len(got) < n:
        full = np.full(max(n, CHUNK + (1 << 17)), base, np.uint64)
        full[0] = 1
        got = _pow[base] = np.multiply.accumulate(full)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slice_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each b[start:end]."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    x = table[b]
    x *= powers(_BASE, n)
    np.cumsum(x, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False


def words(b: np.ndarray, o: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of member bytes that stays within a text, and each text's first run (n + 1)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(o), np.int64)
    w = member[b]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = o[:-1][o[:-1] < len(b)]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cut = o[1:][o[1:] > 0] - 1
    last[cut] = w[cut]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, o)
