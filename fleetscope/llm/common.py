"""Helpers the corpus operators share: reading, cutting lineage, word and shingle hashing inside tasks."""

import ctypes
import re
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: letters that count as capitals, and what they become
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASK = 0xFFFFFFFFFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, survives lost executors, and has a known size.

    The table goes by ``dropped``, or when the session's file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    _places[table] = place
    return table


_places: "weakref.WeakKeyDictionary[DataFrame, object]" = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` early. For those whose every use is itself written by now, so that no lost executor needs them again."""
    for table in tables:
        place = _places.pop(table)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, limit: str = "8m") -> None:
    """Arrow batches of at most so many bytes, so that very long texts meet only a few others in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def give_back() -> None:
    """Returns memory a task has freed to the system; Python workers live on and their executor counts it as used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it holds
        return


# ---- vectors --------------------------------------------------------------------------------------


def vectors(df: DataFrame, vec: str, embedding: str) -> tuple[DataFrame, int, int]:
    """Rows (id, e: doubles) whose vector takes part, their length, and how many they are.

    A vector takes part when it is not null, holds no null or non-finite entry and has the length most of
    these have (of equally frequent lengths the greater); an empty vector never does. Length 0: no row does.
    """
    e = F.col("e")
    rows = df.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where(
        (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    lengths = rows.groupBy(F.size(e).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims, n = (lengths[0]["dims"], lengths[0]["count"]) if lengths else (0, 0)
    return rows.where(F.size(e) == dims), dims, n


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` doubles as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


# ---- words and shingles as numbers ----------------------------------------------------------------

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: bytes of a long text that are hashed together
_BLOCK = 1 << 17
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept up to a bound and made anew beyond it."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 1 << 16)
    made = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 1 << 21:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    The bytes are polynomial prefix sums modulo 2^64; a word's hash is the difference at its ends, shifted to
    a common place, so that no Python runs per word. A long text is taken in blocks that end at a white space;
    the arrays of a block take some 50 bytes a byte.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= _BLOCK:
        return _hashed(raw)
    out, low = [], 0
    while low < len(raw):
        cut = _SPACE.search(raw, low + _BLOCK)
        high = cut.start() if cut else len(raw)
        out.append(_hashed(raw[low:high]))
        low = high
    return np.concatenate(out)


def _hashed(raw: bytes) -> np.ndarray:
    """The hashes of a block's words."""
    if not raw:
        return np.empty(0, np.uint64)
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    space = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], dtype=np.uint64)))
        return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words; fewer words are one run; none gives none."""
    n = len(words)
    if n == 0:
        return words
    out = np.zeros(max(1, n - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, n)):
            out = mixed(out ^ words[k : k + len(out)])
        return out if n >= width else mixed(out + np.uint64(n))


def seed(n: int) -> np.uint64:
    return mixed(np.array([n & _MASK], np.uint64))[0]
